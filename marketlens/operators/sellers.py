"""Seller benchmarking and classification.

Shape: items ⋈ orders ⟕ per-order review summary, all on ``order_id``
(co-partitioned: one shuffle per input), then aggregated per seller (or
seller × category) *before* the sellers dimension is joined.  An order's first item of a
seller is marked where the join sorts the items anyway, so different orders are a sum and no
task holds its (seller, order) pairs in hash tables.  The published
statements join ``reviews`` without a key, multiplying item rows by the
order's review count; that multiplicity is carried as a row weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import as_dec2, as_dec10, avg2, pct, r, ratio
from marketlens.functions.rules import CANCELED, SellerRule
from marketlens.operators.common import (
    fanout_weight,
    review_score_cnt,
    review_score_sum,
    review_stats,
    sort_small,
    split_join,
    top_k,
    with_scalar,
)
from marketlens.sources.tables import Tables


def _in_orders(t: Tables, items: DataFrame, *group: str) -> DataFrame:
    """``items`` joined to their orders; ``new_order`` marks one row of each order and ``group``.

    Within an order the items are sorted by ``group``: a row's number is its rank only in the first
    of equal ones.  An order that comes in copies counts in its first copy."""
    by_group = Window.partitionBy("order_id").orderBy(*group)
    items = items.withColumn("is_first", F.row_number().over(by_group) == F.rank().over(by_group))
    copy = F.row_number().over(Window.partitionBy("order_id").orderBy("order_status"))
    orders = t.orders.select("order_id", "order_status", copy.alias("copy"))
    new = F.col("is_first") & (F.col("copy") == 1)
    return items.join(orders, "order_id").withColumn("new_order", F.when(new, 1).otherwise(0)).drop("is_first", "copy")


def _item_rows(t: Tables) -> DataFrame:
    items = t.order_items.select("order_id", "seller_id", "price")
    return _in_orders(t, items, "seller_id").join(review_stats(t.reviews), "order_id", "left")


def _fanout_metrics(cancelled: str) -> list:
    w = fanout_weight()
    priced = F.when(F.col("price").isNotNull(), w)
    return [
        F.sum("new_order").alias("total_orders"),
        r(F.sum(F.col("price") * w)).alias("total_revenue"),
        r(ratio(F.sum(F.col("price") * w), F.sum(priced))).alias("avg_order_value"),
        r(ratio(F.sum(review_score_sum()), F.sum(review_score_cnt()))).alias("avg_review_score"),
        F.sum(F.when(F.col("order_status") == cancelled, w).otherwise(0)).alias("cancellations"),
    ]


def seller_category_benchmark(t: Tables, cancelled: str = CANCELED, min_orders: int = 10, k: int | None = 30) -> DataFrame:
    items = t.order_items.select("order_id", "seller_id", "product_id", "price")
    items = split_join(items, t.products.select("product_id", "product_category_name"), "product_id", t.hot.get("product_id", ())).drop("product_id")
    rows = _in_orders(t, items, "seller_id", "product_category_name").join(review_stats(t.reviews), "order_id", "left")
    per_group = rows.groupBy("seller_id", "product_category_name").agg(*_fanout_metrics(cancelled))
    out = (
        per_group.where(F.col("total_orders") >= min_orders)
        .join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "product_category_name",
            "total_orders",
            "total_revenue",
            "avg_order_value",
            "avg_review_score",
            "cancellations",
            pct("cancellations", "total_orders").alias("cancellation_rate"),
        )
    )
    order = [
        F.col("product_category_name").asc_nulls_first(),
        F.col("total_revenue").desc_nulls_last(),
        F.col("seller_id").asc_nulls_first(),
    ]
    return top_k(out, order, k)


def _known(t: Tables, df: DataFrame, check: bool) -> DataFrame:
    # Sellers missing from the sellers table drop out, as the inner join does.
    return df.join(t.sellers.select("seller_id"), "seller_id", "left_semi") if check else df


def seller_sums(t: Tables, cancelled: str = CANCELED) -> DataFrame:
    """Per seller: the sums that ``base_of_sums`` makes the rounded figures of."""
    w = fanout_weight()
    return _item_rows(t).groupBy("seller_id").agg(
        F.sum("new_order").alias("total_orders"),
        F.sum(F.col("price") * w).alias("price_sum"),
        F.sum(F.when(F.col("price").isNotNull(), w)).alias("price_cnt"),
        F.sum(review_score_sum()).alias("rv_sum"),
        F.sum(review_score_cnt()).alias("rv_cnt"),
        F.sum(F.when(F.col("order_status") == cancelled, w).otherwise(0)).alias("cancellations"),
    )


def base_of_sums(sums: DataFrame, *others: str) -> DataFrame:
    """Rounded revenue, review and cancellation rate per seller, with ``total_orders`` and ``others``."""
    return sums.select(
        "seller_id",
        "total_orders",
        r("price_sum").alias("total_revenue"),
        r(ratio("rv_sum", "rv_cnt")).alias("avg_review_score"),
        pct("cancellations", "total_orders").alias("cancellation_rate"),
        *others,
    )


def seller_base(t: Tables, cancelled: str = CANCELED, min_orders: int = 10, check_sellers: bool = True) -> DataFrame:
    """Per seller with at least ``min_orders`` distinct orders: rounded revenue,
    review and cancellation rate over item × review rows (as published).

    ``check_sellers=False`` leaves the existence check to a caller that joins
    the sellers table anyway (one scan of the dimension instead of two)."""
    per_seller = _item_rows(t).groupBy("seller_id").agg(*_fanout_metrics(cancelled))
    return (
        _known(t, per_seller.where(F.col("total_orders") >= min_orders), check_sellers)
        .select(
            "seller_id",
            "total_revenue",
            "avg_review_score",
            pct("cancellations", "total_orders").alias("cancellation_rate"),
        )
    )


def seller_base_by_order(t: Tables, cancelled: str = CANCELED, min_orders: int = 10, check_sellers: bool = True) -> DataFrame:
    """Corrected base: reviews averaged per order before the join, so nothing is multiplied."""
    items = t.order_items.select("order_id", "seller_id", "price")
    per_order_review = review_stats(t.reviews).select(
        "order_id", as_dec10(ratio("rv_sum", "rv_cnt")).alias("order_review")
    )
    rows = _in_orders(t, items, "seller_id").join(per_order_review, "order_id", "left")
    per_seller = rows.groupBy("seller_id").agg(
        F.sum("new_order").alias("total_orders"),
        r(F.sum("price")).alias("total_revenue"),
        avg2("order_review").alias("avg_review_score"),
        F.sum(F.when(F.col("order_status") == cancelled, 1).otherwise(0)).alias("cancellations"),
    )
    return (
        _known(t, per_seller.where(F.col("total_orders") >= min_orders), check_sellers)
        .select(
            "seller_id",
            "total_revenue",
            "avg_review_score",
            pct("cancellations", "total_orders").alias("cancellation_rate"),
        )
    )


def classify(base: DataFrame, rule: SellerRule = SellerRule()) -> DataFrame:
    """The ladder reads the *rounded* metrics, as published."""
    label = rule.label(F.col("total_revenue"), F.col("avg_review_score"), F.col("cancellation_rate"))
    return base.withColumn("seller_classification", label)


def _listing(t: Tables, base: DataFrame, rule: SellerRule, k: int | None) -> DataFrame:
    out = classify(base, rule).join(t.sellers.select("seller_id", "seller_city"), "seller_id").select(
        "seller_id", "seller_city", "total_revenue", "avg_review_score", "cancellation_rate", "seller_classification"
    )
    return top_k(out, [F.col("total_revenue").desc_nulls_last(), F.col("seller_id").asc_nulls_first()], k)


def seller_classification(
    t: Tables, rule: SellerRule = SellerRule(), cancelled: str = CANCELED, min_orders: int = 10, k: int | None = 40
) -> DataFrame:
    return _listing(t, seller_base(t, cancelled, min_orders, check_sellers=False), rule, k)


def seller_classification_by_order(
    t: Tables, rule: SellerRule = SellerRule(), cancelled: str = CANCELED, min_orders: int = 10, k: int | None = 40
) -> DataFrame:
    return _listing(t, seller_base_by_order(t, cancelled, min_orders, check_sellers=False), rule, k)


def seller_classification_summary(
    t: Tables, rule: SellerRule = SellerRule(), cancelled: str = CANCELED, min_orders: int = 10
) -> DataFrame:
    """Class sizes; the percentage base is every seller in the sellers table."""
    classes = classify(seller_base(t, cancelled, min_orders), rule).groupBy("seller_classification").agg(
        F.count(F.lit(1)).alias("total_sellers"),
        avg2(as_dec2("total_revenue")).alias("avg_revenue"),
        avg2(as_dec2("avg_review_score")).alias("avg_review_score"),
        avg2(as_dec2("cancellation_rate")).alias("avg_cancellation_rate"),
    )
    all_sellers = t.sellers.agg(F.countDistinct("seller_id").alias("all_sellers"))
    return with_scalar(classes, all_sellers).select(
        "seller_classification",
        "total_sellers",
        pct("total_sellers", "all_sellers").alias("pct_of_all_sellers"),
        "avg_revenue",
        "avg_review_score",
        "avg_cancellation_rate",
    ).transform(sort_small, F.col("total_sellers").desc(), F.col("seller_classification").asc_nulls_first())
