"""Delivery performance: late orders and the delivery scorecard.

Reviews are joined as a per-order summary (``review_stats``), so the LEFT
JOIN is many-to-one: the published fan-out (an order with two reviews is
two rows) is reproduced with row weights instead of multiplied rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import as_dec10, avg2, pct, r, ratio
from marketlens.functions.rules import DELIVERED, DeliveryRule
from marketlens.operators.common import (
    fanout_weight,
    review_score_cnt,
    review_score_sum,
    review_stats,
    sort_small,
    top_k,
    with_group_total,
)
from marketlens.sources.tables import Tables

DELIVERED_AT = "order_delivered_customer_date"
ESTIMATED_AT = "order_estimated_delivery_date"


def delivered_orders(t: Tables, delivered: str = DELIVERED) -> DataFrame:
    """Delivered orders with both a delivery date and an estimate."""
    return t.orders.where(
        (F.col("order_status") == delivered) & F.col(DELIVERED_AT).isNotNull() & F.col(ESTIMATED_AT).isNotNull()
    )


def late_delivery_orders(t: Tables, rule: DeliveryRule = DeliveryRule(), k: int | None = 20) -> DataFrame:
    """Delivered orders × their reviews, worst delay first.

    One join on order_id (co-located on order-keyed marts) under a top-k:
    nothing runs until the result is read, and each table is read once.
    """
    orders = delivered_orders(t).select(
        "order_id",
        "order_status",
        F.to_date("order_purchase_timestamp").alias("purchase_date"),
        F.to_date(ESTIMATED_AT).alias("promised_delivery"),
        F.to_date(DELIVERED_AT).alias("actual_delivery"),
        F.datediff(DELIVERED_AT, ESTIMATED_AT).alias("days_late"),
        rule.label(F.col(DELIVERED_AT), F.col(ESTIMATED_AT)).alias("delivery_status"),
    )
    order_rank = [F.col("days_late").desc_nulls_last(), F.col("order_id").asc_nulls_first()]
    reviews = t.reviews.select("order_id", "review_score")
    joined = orders.join(reviews, "order_id", "left").select(
        "order_id",
        "order_status",
        "purchase_date",
        "promised_delivery",
        "actual_delivery",
        "days_late",
        "delivery_status",
        "review_score",
    )
    return top_k(joined, order_rank + [F.col("review_score").asc_nulls_first()], k)


def _tiered(t: Tables, rule: DeliveryRule) -> DataFrame:
    return delivered_orders(t).select(
        "order_id",
        rule.label(F.col(DELIVERED_AT), F.col(ESTIMATED_AT), tiered=True).alias("delivery_tier"),
        F.datediff(DELIVERED_AT, ESTIMATED_AT).alias("days_late"),
    ).join(review_stats(t.reviews), "order_id", "left")


def delivery_scorecard(t: Tables, rule: DeliveryRule = DeliveryRule()) -> DataFrame:
    """Tiers over order × review rows (as published); the percentage base is
    the unjoined count of delivered orders, so tiers can sum past 100."""
    w = fanout_weight()
    tiers = _tiered(t, rule).groupBy("delivery_tier").agg(
        F.sum(w).alias("total_orders"),
        F.count(F.lit(1)).alias("tier_orders"),
        r(ratio(F.sum(review_score_sum()), F.sum(review_score_cnt()))).alias("avg_review_score"),
        r(ratio(F.sum(F.col("days_late") * w), F.sum(F.when(F.col("days_late").isNotNull(), w))), 1).alias("avg_days_late"),
    )
    # Each delivered order is in exactly one tier: the base is the sum of the tiers.
    return with_group_total(tiers, "tier_orders", "delivered_orders").select(
        "delivery_tier",
        "total_orders",
        pct("total_orders", "delivered_orders").alias("pct_of_delivered"),
        "avg_review_score",
        "avg_days_late",
    ).transform(sort_small, F.col("delivery_tier").asc_nulls_first())


def delivery_scorecard_by_order(t: Tables, rule: DeliveryRule = DeliveryRule()) -> DataFrame:
    """Corrected scorecard: one row per order, reviews averaged per order first,
    so the tier percentages sum to 100."""
    per_order = _tiered(t, rule).withColumn("order_review", as_dec10(ratio("rv_sum", "rv_cnt")))
    tiers = per_order.groupBy("delivery_tier").agg(
        F.count(F.lit(1)).alias("total_orders"),
        avg2("order_review").alias("avg_review_score"),
        avg2("days_late", 1).alias("avg_days_late"),
    )
    return with_group_total(tiers, "total_orders", "delivered_orders").select(
        "delivery_tier",
        "total_orders",
        pct("total_orders", "delivered_orders").alias("pct_of_delivered"),
        "avg_review_score",
        "avg_days_late",
    ).transform(sort_small, F.col("delivery_tier").asc_nulls_first())
