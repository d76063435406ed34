"""Revenue leakage: order status, revenue at risk, cancellations, freight margins.

Line items are the largest table; every job here reduces them before they
are joined (per order, per seller or per product: a map-side partial
aggregate) so the join and the shuffle carry aggregates, not item rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import as_dec10, pct, r, ratio, sum_if, wavg2
from marketlens.functions.rules import CANCELED, FreightRule
from marketlens.operators.common import sort_small, split_join, top_k, with_group_total
from marketlens.sources.tables import Tables


def order_status_breakdown(t: Tables, collation: str | None = None) -> DataFrame:
    """``collation``: statuses that it takes for equal are one group, shown by its least spelling."""
    status = F.col("order_status")
    if collation is None:
        by_status = t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("total_orders"))
    else:
        spelled = t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))
        merged = spelled.groupBy(F.collate(status, collation).alias("key")).agg(F.min("order_status").alias("order_status"), F.sum("n").alias("total_orders"))
        by_status = merged.drop("key")
    # Every order falls in exactly one status group, so the total is the sum of the groups.
    return with_group_total(by_status, "total_orders", "all_orders").select(
        "order_status",
        "total_orders",
        pct("total_orders", "all_orders").alias("percentage_of_all_orders"),
    ).transform(sort_small, F.col("total_orders").desc(), F.col("order_status").asc_nulls_first())


def order_item_sums(t: Tables) -> DataFrame:
    """Per order: item-row sums needed by the status jobs (one row per order with items)."""
    i = t.order_items
    return i.groupBy("order_id").agg(
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_cnt"),
        F.sum("freight_value").alias("freight_sum"),
        F.sum(F.col("price") + F.col("freight_value")).alias("gross_sum"),
    )


def _status_totals(t: Tables) -> DataFrame:
    orders = t.orders.select("order_id", "order_status")
    return orders.join(order_item_sums(t), "order_id")


def status_rollup(t: Tables) -> DataFrame:
    """Per status: distinct orders with items and exact (decimal) item sums.

    P02, C02 and the KPI report are projections of this one aggregate."""
    return _status_totals(t).groupBy("order_status").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_cnt").alias("price_cnt"),
        F.sum("freight_sum").alias("freight_sum"),
        F.sum("gross_sum").alias("gross_sum"),
    )


def revenue_leakage_by_status(t: Tables) -> DataFrame:
    return status_rollup(t).select(
        "order_status",
        "total_orders",
        r("price_sum").alias("total_product_revenue"),
        r("freight_sum").alias("total_freight_charged"),
        r("gross_sum").alias("total_revenue_at_risk"),
        r(ratio("price_sum", "price_cnt")).alias("avg_order_value"),
    ).transform(sort_small, F.col("total_revenue_at_risk").desc_nulls_last(), F.col("order_status").asc_nulls_first())


def average_order_value(t: Tables) -> DataFrame:
    """Corrected AOV: revenue per distinct order, next to the mean item price."""
    return status_rollup(t).select(
        "order_status",
        "total_orders",
        r("price_sum").alias("total_product_revenue"),
        r(ratio("price_sum", "price_cnt")).alias("avg_item_price"),
        r(ratio("price_sum", "total_orders")).alias("avg_order_value"),
    ).transform(sort_small, F.col("order_status").asc_nulls_first())


def _seller_item_status(t: Tables) -> DataFrame:
    items = t.order_items.select("order_id", "seller_id", "price")
    return items.join(t.orders.select("order_id", "order_status"), "order_id")


def seller_cancellation_ranking(t: Tables, cancelled: str = CANCELED, k: int | None = 20) -> DataFrame:
    is_cancelled = F.col("order_status") == cancelled
    per_seller = _seller_item_status(t).groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        sum_if(is_cancelled).alias("cancelled_orders"),
        r(sum_if(is_cancelled, "price")).alias("revenue_lost_to_cancellations"),
    )
    out = (
        per_seller.where(F.col("cancelled_orders") > 0)
        .join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "total_orders",
            "cancelled_orders",
            pct("cancelled_orders", "total_orders").alias("cancellation_rate_pct"),
            "revenue_lost_to_cancellations",
        )
    )
    return top_k(out, [F.col("cancellation_rate_pct").desc_nulls_last(), F.col("seller_id").asc_nulls_first()], k)


def seller_cancellation_by_order(t: Tables, cancelled: str = CANCELED, k: int | None = 20) -> DataFrame:
    """Corrected rate: distinct cancelled orders over distinct orders (at most 100 %)."""
    per_order = _seller_item_status(t).groupBy("seller_id", "order_id").agg(
        F.max((F.col("order_status") == cancelled).cast("int")).alias("is_cancelled")
    )
    per_seller = per_order.where(F.col("order_id").isNotNull()).groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.coalesce(F.col("is_cancelled"), F.lit(0))).cast("bigint").alias("cancelled_orders"),
    )
    out = (
        per_seller.where(F.col("cancelled_orders") > 0)
        .join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "total_orders",
            "cancelled_orders",
            pct("cancelled_orders", "total_orders").alias("cancellation_rate_pct"),
        )
    )
    return top_k(out, [F.col("cancellation_rate_pct").desc_nulls_last(), F.col("seller_id").asc_nulls_first()], k)


def _freight_pct():
    return ratio("freight_value", "price") * F.lit(100.0)


def freight_margin_risk_items(t: Tables, rule: FreightRule = FreightRule(), k: int | None = 20) -> DataFrame:
    items = t.order_items.where(F.col("price") > 0).select("order_id", "product_id", "seller_id", "price", "freight_value")
    # Both joins are at item grain, where a product or seller may hold a large share of the rows.
    joined = split_join(items, t.products.select("product_id", "product_category_name"), "product_id", t.hot.get("product_id", ()))
    joined = split_join(joined, t.sellers.select("seller_id", "seller_state"), "seller_id", t.hot.get("seller_id", ()))
    out = joined.select(
        "order_id",
        r("price").alias("product_price"),
        r("freight_value").alias("freight_cost"),
        r(_freight_pct()).alias("freight_as_pct_of_price"),
        rule.label(F.col("price"), F.col("freight_value")).alias("margin_risk_category"),
        "product_category_name",
        "seller_state",
    )
    # Line items are not unique, so every output column breaks ties.
    order = [F.col("freight_as_pct_of_price").desc_nulls_last()] + [
        F.col(c).asc_nulls_first()
        for c in ("order_id", "product_price", "freight_cost", "margin_risk_category", "product_category_name", "seller_state")
    ]
    return top_k(out, order, k)


def product_freight_sums(t: Tables) -> DataFrame:
    """Per product: sums over its priced items, from which category averages are made."""
    p, f = F.col("price"), F.col("freight_value")
    critical = f >= p
    return t.order_items.where(p > 0).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("price_sum"),
        F.count(p).alias("price_cnt"),
        F.sum(f).alias("freight_sum"),
        F.count(f).alias("freight_cnt"),
        F.sum(as_dec10(_freight_pct())).alias("pct_sum"),
        F.count(as_dec10(_freight_pct())).alias("pct_cnt"),
        sum_if(critical).alias("critical"),
        sum_if(critical, f - p).alias("lost"),
    )


def category_freight(per_product: DataFrame, k: int | None = 15) -> DataFrame:
    """The report of categories from ``product_freight_sums`` with their products' category."""
    per_category = per_product.groupBy("product_category_name").agg(
        F.sum("n").alias("total_items"),
        wavg2("price_sum", "price_cnt").alias("avg_product_price"),
        wavg2("freight_sum", "freight_cnt").alias("avg_freight_cost"),
        wavg2("pct_sum", "pct_cnt").alias("avg_freight_pct"),
        F.sum("critical").alias("critical_items"),
        r(F.sum("lost")).alias("total_money_lost"),
    )
    out = per_category.where(F.col("critical_items") > 0)
    return top_k(
        out,
        [F.col("total_money_lost").desc_nulls_last(), F.col("product_category_name").asc_nulls_first()],
        k,
    )


def category_margin_risk(t: Tables, k: int | None = 15) -> DataFrame:
    categories = t.products.select("product_id", "product_category_name")
    return category_freight(product_freight_sums(t).join(categories, "product_id"), k)
