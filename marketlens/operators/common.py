"""Plan pieces shared by the jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir
from marketlens.sources.tables import Tables


def top_k(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """Sorted report; with ``k`` it plans as TakeOrderedAndProject (per-partition
    top-k, then one merge of at most k × partitions rows), never a global sort."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def sort_small(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort a result whose size is bounded by the groups of a low-cardinality
    key (statuses, tiers, segments, months, audit rows): one partition and a
    local sort, instead of a range-partition sampling job and a shuffle.
    Never used on anything that grows with the input."""
    return df.coalesce(1).sortWithinPartitions(*order)


def checkpoint_once(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared ``spark.checkpoint.dir``) computed once.

    An eager checkpoint runs one job to evaluate and a second to write the
    files; persisting first makes the second job read the cached rows
    instead of recomputing the plan.  The cache is dropped once the files
    are written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def with_group_total(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Add ``sum(col)`` over all rows of a grouped result bounded by a
    low-cardinality key (a handful of statuses or tiers).  A window over those
    few rows, instead of a second aggregate that would scan the input again."""
    return df.withColumn(alias, F.sum(col).over(Window.partitionBy()))


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    ``scalar`` must be a global aggregate (exactly one row by construction),
    so broadcasting it is bounded regardless of input size.
    """
    return df.crossJoin(F.broadcast(scalar))


#: Columns of the items on which large joins are split, and the tables joined on them.
SPLIT_KEYS = {"product_id": "products", "seller_id": "sellers"}
#: A value is hot if it holds this share of the rows or more; so at most 1/HOT_SHARE values are.
HOT_SHARE = 0.005
#: Values that the frequency sketch follows: its counts are off by a share of about 1/TRACKED at most.
TRACKED = 16_384


def hot_candidates(df: DataFrame, columns: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """(column_name, value): at most 1/share values of each column, among them every one that holds
    ``share`` of the rows, by one frequency sketch over the columns (a partial aggregate of fixed size)."""
    most = int(1 / share) + 1
    sketch = lambda c: F.expr(f"approx_top_k(cast({c} as string), {most}, {TRACKED})")
    found = df.agg(F.count(F.lit(1)).alias("n"), *(sketch(c).alias(c) for c in columns))
    each = [found.select(F.lit(c).alias("column_name"), "n", F.explode(c).alias("v")) for c in columns]
    slack = share - 2 / TRACKED
    out = reduce(DataFrame.unionByName, each).where(F.col("v.item").isNotNull() & (F.col("v.count") >= F.col("n") * slack))
    return out.select("column_name", F.col("v.item").alias("value"))


#: Rows that a hot value may have in the dimension that is broadcast for it.
MAX_COPIES = 100


def hot_keys(t: Tables, dimensions: Mapping[str, str] = SPLIT_KEYS, share: float = HOT_SHARE) -> dict[str, list[str]]:
    """By column of the items, the values that hold about ``share`` of the rows or more.

    ``dimensions``: the table that is joined on each column.  A value with more than MAX_COPIES rows
    there (its key is declared unique, but nothing enforces that) is left out, so that what
    ``split_join`` broadcasts is at most MAX_COPIES / share rows.  At most 1/share values of a column reach the driver.
    """
    out: dict[str, list[str]] = {}
    found = [(row.column_name, row.value) for row in hot_candidates(t.order_items, list(dimensions), share).collect()]
    for column, table in dimensions.items():
        values = sorted(v for c, v in found if c == column)
        rows = getattr(t, table).where(F.col(column).isin(*values)).groupBy(column).count().where(F.col("count") > MAX_COPIES)
        copied = {r[column] for r in rows.collect()} if values else set()
        out[column] = [v for v in values if v not in copied]
    return out


def with_hot_keys(t: Tables, share: float = HOT_SHARE) -> Tables:
    """The same tables with the items' hot values: one scan of those columns."""
    return t.replace(hot=hot_keys(t, share=share))


def split_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence[str]) -> DataFrame:
    """Inner equi-join of ``left`` with ``right`` on a string ``key`` where ``hot`` values hold much of ``left``.

    Rows of hot values meet their rows of ``right`` by broadcast, whose size ``hot_keys`` has
    bounded.  All others take the shuffle.  One read of ``left``: hot rows pass the shuffled join under
    made-up keys of their own, spread evenly, and match nothing there.
    """
    if not hot:
        return left.join(right, key)
    columns = [c for c in right.columns if c != key]
    is_hot = F.col(key).isin(*hot)
    few = right.where(is_hot).select(key, F.struct(*columns).alias("__hot"))
    rest = right.where(~is_hot).select(F.col(key).alias("__key"), F.struct(*columns).alias("__rest"))
    own = F.concat(F.lit("\0hot "), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    marked = left.join(F.broadcast(few), key, "left").withColumn("__key", F.when(is_hot, own).otherwise(F.col(key)))
    joined = marked.join(rest, "__key", "left").withColumn("__found", F.when(is_hot, F.col("__hot")).otherwise(F.col("__rest")))
    return joined.where("__found is not null").select(*left.columns, *(F.col("__found")[c].alias(c) for c in columns))


def review_stats(reviews: DataFrame) -> DataFrame:
    """Reviews reduced to one row per order.

    ``rv_rows``  — number of review rows (each multiplies the order's rows in a
                   LEFT JOIN to reviews),
    ``rv_sum`` / ``rv_cnt`` — sum and count of non-NULL scores.

    Joining this instead of the raw reviews keeps the join many-to-one, so
    the published fan-out (an order with two reviews counts twice) is
    computed with weights instead of materialising the multiplied rows.

    Nearly every review is its order's only one, so a hash table by order would
    hold about as many entries as there are reviews, before the shuffle and after it.  The
    reviews are sorted by order instead, as the join wants them, and an order's first row stays.
    """
    in_order = Window.partitionBy("order_id").orderBy("review_score")
    of_order = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stats = reviews.select(
        "order_id",
        F.count(F.lit(1)).over(of_order).alias("rv_rows"),
        F.sum("review_score").over(of_order).alias("rv_sum"),
        F.count("review_score").over(of_order).alias("rv_cnt"),
        F.row_number().over(in_order).alias("row"),
    )
    return stats.where(F.col("row") == 1).drop("row")


def hashed_review_stats(reviews: DataFrame) -> DataFrame:
    """The rows of ``review_stats`` by one hash aggregation, for ``summary``'s order facts: a separate read of the reviews, as before."""
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rv_rows"),
        F.sum("review_score").alias("rv_sum"),
        F.count("review_score").alias("rv_cnt"),
    )


def fanout_weight() -> Column:
    """Rows an input row becomes after ``LEFT JOIN reviews``: the review count, at least 1."""
    return F.coalesce(F.col("rv_rows"), F.lit(1)).cast("bigint")


def review_score_sum() -> Column:
    return F.coalesce(F.col("rv_sum"), F.lit(0)).cast("bigint")


def review_score_cnt() -> Column:
    return F.coalesce(F.col("rv_cnt"), F.lit(0)).cast("bigint")
