"""Load checks and data-quality audits.

The reference relies on the database for keys and checks row counts by eye;
here each check is a distributed aggregate whose result is a small report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketlens.functions.numeric import pct
from marketlens.functions.rules import EXCLUDED_STATUSES
from marketlens.operators.common import hot_candidates, sort_small, with_scalar
from marketlens.sources.schemas import PRIMARY_KEYS, SCHEMAS, VARCHAR_WIDTHS
from marketlens.sources.tables import TABLE_NAMES, Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_row_counts(t: Tables) -> DataFrame:
    """One row, one column per table (eight global counts pivoted into columns)."""
    frames = [getattr(t, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in TABLE_NAMES]
    return _union(frames).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in TABLE_NAMES))


def key_uniqueness_audit(t: Tables) -> DataFrame:
    """Per declared primary key: rows, distinct keys, NULL keys and surplus copies.

    Keys are counted per key first (partial aggregate), so a heavily
    duplicated key is one row after the map side, not a hot shuffle key.
    """
    frames = []
    for table, key in PRIMARY_KEYS.items():
        per_key = getattr(t, table).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        frames.append(
            per_key.agg(
                F.lit(table).alias("table_name"),
                F.lit(key).alias("key_column"),
                F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("rows"),
                F.count("k").alias("distinct_keys"),
                F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).cast("bigint").alias("null_keys"),
                F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("c") - 1)), F.lit(0)).cast("bigint").alias("duplicate_rows"),
            )
        )
    return _union(frames).transform(sort_small, "table_name")


def blank_value_audit(t: Tables) -> DataFrame:
    """NULL and blank (empty or whitespace-only string) counts for every column."""
    frames = []
    for table, schema in SCHEMAS.items():
        df = getattr(t, table)
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for f in schema:
            c = F.col(f.name)
            aggs.append(F.sum(F.when(c.isNull(), 1).otherwise(0)).cast("bigint").alias(f"n__{f.name}"))
            blank = (F.trim(c) == "") if isinstance(f.dataType, StringType) else F.lit(False)
            aggs.append(F.sum(F.when(blank, 1).otherwise(0)).cast("bigint").alias(f"b__{f.name}"))
        wide = df.agg(*aggs)
        pairs = ", ".join(f"'{f.name}', `n__{f.name}`, `b__{f.name}`" for f in schema)
        long = wide.selectExpr(
            f"'{table}' AS table_name",
            "__rows AS rows",
            f"stack({len(schema)}, {pairs}) AS (column_name, null_values, blank_values)",
        )
        frames.append(long)
    return _union(frames).transform(sort_small, "table_name", "column_name")


# Reference checks: (child table, child column, parent table, parent column).
FOREIGN_REFERENCES = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
)


def orphan_and_length_audit(t: Tables) -> DataFrame:
    """Rows an inner join would silently drop (no foreign keys are declared),
    and strings longer than their declared VARCHAR width.

    Each table is read once for both checks: a row gives one entry per reference and
    one with the bits of its overlong strings, if any.  They meet the parents' keys in one
    aggregation by key (a partial aggregate first, so a hot key is a single row a task), which
    says whether the parent has a key and how many rows of each child do; nothing is sorted or joined.
    """
    parents = sorted({(parent, pcol) for _, _, parent, pcol in FOREIGN_REFERENCES})
    children = [[(child, ccol) for child, ccol, *of in FOREIGN_REFERENCES if tuple(of) == key] for key in parents]
    found, checks = [], []
    for number, table in enumerate(TABLE_NAMES):
        entries = []
        for rule, (key, referring) in enumerate(zip(parents, children)):
            for slot, (child, ccol) in enumerate(referring):
                if child == table:
                    entries.append(_entry(rule, F.col(ccol).cast("string"), slot))
                    checks.append((("orphan", table, ccol, ".".join(key)), F.col("rule") == rule, slot))
        widths = VARCHAR_WIDTHS.get(table, {})
        overlong = reduce(lambda a, b: a + b, [F.when(F.length(c) > n, 1 << i).otherwise(0) for i, (c, n) in enumerate(widths.items())], F.lit(0))
        entries.append(F.when(overlong != 0, _entry(-1 - number, overlong.cast("string"), 0)))
        for i, (c, n) in enumerate(widths.items()):
            has = F.col("value").try_cast("int").bitwiseAND(F.lit(1 << i)) != 0
            checks.append((("length", table, c, f"length <= {n}"), (F.col("rule") == -1 - number) & has, 0))
        found.append(getattr(t, table).select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*"))
    for rule, (parent, pcol) in enumerate(parents):
        value = F.col(pcol).cast("string")
        found.append(getattr(t, parent).where(value.isNotNull()).select(_entry(rule, value, PARENT).alias("e")).select("e.*"))
    slots = range(max(map(len, children)))
    rows = [F.count(F.when(F.col("slot") == slot, 1)).alias(f"rows_{slot}") for slot in slots]
    keys = _union(found).groupBy("rule", "value").agg(F.max(F.col("slot") == PARENT).alias("there"), *rows)
    broken = [F.sum(F.when(~F.col("there") & of, F.col(f"rows_{slot}"))).alias(f"n{i}") for i, (_, of, slot) in enumerate(checks)]
    names = ["audit", "table_name", "column_name", "rule"]
    each = [F.struct(*(F.lit(v).alias(c) for c, v in zip(names, said)), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("violations")) for i, (said, _, _) in enumerate(checks)]
    out = keys.agg(*broken).select(F.explode(F.array(*each)).alias("c")).select("c.*")
    return out.transform(sort_small, "audit", "table_name", "column_name")


#: Slot of an entry that is a parent's key; the children of a parent are numbered from 0.
PARENT = -1


def _entry(rule: int, value: Column, slot: int) -> Column:
    return F.struct(F.lit(rule).alias("rule"), value.alias("value"), F.lit(slot).alias("slot"))


# ---------------------------------------------------------------- collation

#: Text that statements compare, group or sort by.
COMPARED = {
    "customers": ("customer_city", "customer_state"),
    "orders": ("order_status",),
    "products": ("product_category_name",),
    "sellers": ("seller_city", "seller_state"),
    "payments": ("payment_type",),
    "geolocation": ("geolocation_city", "geolocation_state"),
}
#: The published server's default comparison: neither case nor accents count.
COLLATION = "UNICODE_CI_AI"


def collated(t: Tables, collation: str = COLLATION) -> Tables:
    """The same tables with the compared text columns under a collation, so that every job on them
    filters, groups, joins and sorts by it: ``'Canceled' = 'canceled'``."""
    frames = {name: getattr(t, name).withColumns({c: F.collate(F.col(c), collation) for c in columns}) for name, columns in COMPARED.items()}
    return t.replace(**frames)


def collation_audit(t: Tables, collation: str = COLLATION) -> DataFrame:
    """Per compared column: different values, different values under the collation, groups of
    values that become one, and the rows in them.

    Values are counted first (a partial aggregate over one scan a table), so the collation is
    applied to values and not to rows.
    """
    found = []
    for table, columns in COMPARED.items():
        entries = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))
        rows = getattr(t, table).select(F.explode(entries).alias("e")).where("e.value is not null")
        found.append(rows.groupBy("e.column_name", "e.value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "column_name", "value", "n"))
    key = F.collate(F.col("value"), collation).alias("key")
    groups = _union(found).groupBy("table_name", "column_name", key).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    several = F.col("spellings") > 1
    out = groups.groupBy("table_name", "column_name").agg(
        F.sum("spellings").alias("distinct_values"),
        F.count(F.lit(1)).alias("distinct_under_collation"),
        F.sum(F.when(several, 1).otherwise(0)).alias("merged_groups"),
        F.sum(F.when(several, F.col("n")).otherwise(0)).alias("merged_rows"),
    )
    return out.transform(sort_small, "table_name", "column_name")


# ---------------------------------------------------------------- rows lost in inner joins

#: Inner joins of the statements, in order: of items with a flag that a row must have to enter, or of
#: orders.  Flags are those of ``_item_flags`` and ``_order_flags``.
ITEM_JOINS = {
    "revenue_leakage_by_status": ("any", ("orders",)),
    "seller_cancellation_ranking": ("any", ("orders", "sellers")),
    "freight_margin_risk_items": ("priced", ("products", "sellers")),
    "category_margin_risk": ("priced", ("products",)),
    "seller_category_benchmark": ("any", ("orders", "products", "sellers")),
    "seller_classification": ("any", ("orders", "sellers")),
}
ORDER_JOINS = {
    "revenue_leakage_by_status": ("any", ("order_items",)),
    "rfm_scores": ("kept", ("customers", "order_items")),
    "cohort_retention": ("kept", ("customers",)),
}


def _marked(df: DataFrame, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with a flag: does ``parent`` have the key?  Parent keys are made distinct first, so no row multiplies."""
    there = parent.where(F.col(key).isNotNull()).select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _item_flags(t: Tables) -> DataFrame:
    """Numbers of items by what they find: reduced to (product, seller) before those joins."""
    items = t.order_items.select("order_id", "product_id", "seller_id", F.coalesce(F.col("price") > 0, F.lit(False)).alias("priced"))
    few = _marked(items, t.orders, "order_id", "orders").groupBy("product_id", "seller_id", "priced", "orders").agg(F.count(F.lit(1)).alias("n"))
    few = _marked(_marked(few, t.products, "product_id", "products"), t.sellers, "seller_id", "sellers")
    return few.groupBy("priced", "orders", "products", "sellers").agg(F.sum("n").alias("n")).withColumn("any", F.lit(True))


def _order_flags(t: Tables, excluded: tuple[str, ...]) -> DataFrame:
    kept = F.coalesce(~F.col("order_status").isin(*excluded), F.lit(False))
    orders = t.orders.select("order_id", "customer_id", kept.alias("kept"))
    rows = _marked(_marked(orders, t.order_items, "order_id", "order_items"), t.customers, "customer_id", "customers")
    return rows.groupBy("kept", "order_items", "customers").agg(F.count(F.lit(1)).alias("n")).withColumn("any", F.lit(True))


def _losses(flags: DataFrame, driving: str, joins: dict) -> DataFrame:
    steps = []
    for statement, (enter, parents) in joins.items():
        enters = F.col(enter)
        for step, parent in enumerate(parents, 1):
            steps.append(F.struct(F.lit(statement).alias("statement"), F.lit(step).alias("step"), F.lit(parent).alias("joined_to"), enters.alias("enters"), (enters & ~F.col(parent)).alias("lost")))
            enters = enters & F.col(parent)
    rows = flags.select("n", F.explode(F.array(*steps)).alias("s"))
    count = lambda flag: F.coalesce(F.sum(F.when(F.col(f"s.{flag}"), F.col("n"))), F.lit(0)).cast("bigint")
    return rows.groupBy("s.statement", "s.step", "s.joined_to").agg(count("enters").alias("rows_in"), count("lost").alias("rows_lost")).withColumn("driving_table", F.lit(driving))


def join_loss_by_statement(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    """Per statement and inner join: rows of the driving table that enter the join, and those that find
    no partner and silently drop out.

    Items and orders are each read once as driving table, whatever the number of statements: a row's flags say which
    parents it has, and every statement's losses follow from the numbers of rows by flags.
    """
    frames = [_losses(_item_flags(t), "order_items", ITEM_JOINS), _losses(_order_flags(t, excluded), "orders", ORDER_JOINS)]
    columns = ["statement", "driving_table", "step", "joined_to", "rows_in", "rows_lost"]
    return _union(frames).select(columns).transform(sort_small, "statement", "driving_table", "step")


# ---------------------------------------------------------------- heavy hitters

def heavy_hitter_audit(t: Tables, share: float = 0.01) -> DataFrame:
    """Products and sellers that hold ``share`` of the items or more, with their exact numbers of rows.

    A frequency sketch finds at most 1/share candidates a column; only their rows are counted
    in a second pass.  These are the values at which joins are split (``common.split_join``).
    """
    columns = ["product_id", "seller_id"]
    candidates = hot_candidates(t.order_items, columns, share)
    entries = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))
    rows = t.order_items.select(F.explode(entries).alias("e")).select("e.*").join(F.broadcast(candidates), ["column_name", "value"])
    counts = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    out = with_scalar(counts, t.order_items.agg(F.count(F.lit(1)).alias("all_rows")))
    out = out.where(F.col("rows") >= F.col("all_rows") * F.lit(share)).select("column_name", "value", "rows", pct("rows", "all_rows").alias("pct_of_rows"))
    return out.transform(sort_small, "column_name", F.col("rows").desc(), "value")
