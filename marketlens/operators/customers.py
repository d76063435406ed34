"""Customer value: RFM scoring, segments, cohorts and retention.

Plan shape shared by the RFM jobs (``rfm_base``):

    kept orders ⋈ customers            (on customer_id)
        ⋈ per-order item totals         (on order_id; items pre-aggregated map-side)
    → group by person                   (distinct orders, spend, last purchase)

Joining the item totals last leaves the rows hash-partitioned on
``order_id``, which already satisfies the first step of the distinct-order
count, so the distinct aggregate adds no extra exchange.  Line items are
pre-aggregated per order before they move, so at most one row per order is
shuffled into the join however many items an order has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import as_dec2, avg2, pct, r, sum_if
from marketlens.functions.rules import (
    DEFAULT_AS_OF,
    EXCLUDED_STATUSES,
    RfmRule,
    SegmentRuleA,
    SegmentRuleB,
)
from marketlens.operators.common import sort_small, top_k
from marketlens.sources.tables import Tables


def _as_of(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def kept_orders(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    """Orders whose status is not excluded (a NULL status is dropped too, as NOT IN does)."""
    return t.orders.where(~F.col("order_status").isin(*excluded))


def order_item_totals(t: Tables) -> DataFrame:
    """One row per order that has at least one item: its summed item price."""
    return t.order_items.groupBy("order_id").agg(F.sum("price").alias("order_price"))


def rfm_base(
    t: Tables,
    as_of: dt.date | str = DEFAULT_AS_OF,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    """Per person: distinct kept orders with items, rounded spend, days since last purchase."""
    orders = kept_orders(t, excluded).select("order_id", "customer_id", "order_purchase_timestamp")
    people = t.customers.select("customer_id", "customer_unique_id")
    joined = orders.join(people, "customer_id").join(order_item_totals(t), "order_id")
    return joined.groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("frequency"),
        r(F.sum("order_price")).alias("monetary"),
        F.datediff(_as_of(as_of), F.max("order_purchase_timestamp")).alias("recency_days"),
    )


def score_rfm(base: DataFrame, rule: RfmRule = RfmRule()) -> DataFrame:
    return base.select(
        "customer_unique_id",
        "frequency",
        "monetary",
        "recency_days",
        rule.recency_score(F.col("recency_days")).alias("recency_score"),
        rule.frequency_score(F.col("frequency")).alias("frequency_score"),
        rule.monetary_score(F.col("monetary")).alias("monetary_score"),
    )


def rfm_scores(
    t: Tables,
    as_of: dt.date | str = DEFAULT_AS_OF,
    rule: RfmRule = RfmRule(),
    k: int | None = 20,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    scored = score_rfm(rfm_base(t, as_of, excluded), rule)
    return top_k(scored, [F.col("monetary").desc_nulls_last(), F.col("customer_unique_id").asc_nulls_first()], k)


def rfm_segments(
    t: Tables,
    as_of: dt.date | str = DEFAULT_AS_OF,
    rule: RfmRule = RfmRule(),
    segments: SegmentRuleA = SegmentRuleA(),
    k: int | None = 20,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    scored = score_rfm(rfm_base(t, as_of, excluded), rule)
    rs, fs, ms = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    out = scored.select(
        "*",
        (rs + fs + ms).alias("rfm_total"),
        segments.label(rs, fs, ms).alias("customer_segment"),
    )
    return top_k(out, [F.col("rfm_total").desc_nulls_last(), F.col("customer_unique_id").asc_nulls_first()], k)


def segment_people(
    t: Tables,
    as_of: dt.date | str = DEFAULT_AS_OF,
    rule: RfmRule = RfmRule(),
    segments: SegmentRuleB = SegmentRuleB(),
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    """Every person of ``rfm_base`` with its rule-set-B segment."""
    scored = score_rfm(rfm_base(t, as_of, excluded), rule)
    label = segments.label(
        F.col("recency_score"),
        F.col("frequency_score"),
        F.col("monetary_score"),
        F.col("recency_days"),
        F.col("frequency"),
        F.col("monetary"),
    )
    return scored.withColumn("customer_segment", label)


def rfm_segment_summary(
    t: Tables,
    as_of: dt.date | str = DEFAULT_AS_OF,
    rule: RfmRule = RfmRule(),
    segments: SegmentRuleB = SegmentRuleB(),
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    """Segment sizes and averages (rule set B); a second aggregate over at most six groups."""
    people = segment_people(t, as_of, rule, segments, excluded)
    return people.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("total_customers"),
        avg2(as_dec2("monetary")).alias("avg_spend"),
        avg2("recency_days", 0).alias("avg_days_since_purchase"),
        avg2("frequency").alias("avg_orders"),
    ).transform(sort_small, F.col("total_customers").desc(), F.col("customer_segment").asc_nulls_first())


def person_orders(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    """Per person: distinct kept orders (items not required) and first kept purchase."""
    orders = kept_orders(t, excluded).select("order_id", "customer_id", "order_purchase_timestamp")
    people = t.customers.select("customer_id", "customer_unique_id")
    return orders.join(people, "customer_id").groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.min("order_purchase_timestamp").alias("first_purchase"),
    )


def cohort_retention(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    per_person = person_orders(t, excluded).withColumn(
        "cohort_month", F.date_format("first_purchase", "yyyy-MM")
    )
    n = F.col("total_orders")
    # One row per person here, so counting non-NULL persons is the distinct count.
    return per_person.groupBy("cohort_month").agg(
        F.count("customer_unique_id").alias("cohort_size"),
        sum_if(n >= 1).alias("active_customers"),
        sum_if(n >= 2).alias("returned_for_2nd_order"),
        sum_if(n >= 3).alias("returned_for_3rd_order"),
        sum_if(n >= 4).alias("returned_4th_plus"),
        pct(sum_if(n >= 2), F.count("customer_unique_id")).alias("retention_rate_pct"),
    ).transform(sort_small, F.col("cohort_month").asc_nulls_first())


def overall_retention(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    """Retention as published: the numerator counts customer *rows* of repeat persons.

    The customers table is pre-aggregated to (person, rows) before the join,
    so a person with very many customer rows is one row on each side of the
    join instead of a hot key.
    """
    rows_per_person = t.customers.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("customer_rows"))
    counts = person_orders(t, excluded).select("customer_unique_id", "total_orders")
    joined = rows_per_person.join(counts, "customer_unique_id")
    repeat_rows = sum_if(F.col("total_orders") >= 2, "customer_rows")
    return joined.agg(
        F.count("customer_unique_id").alias("total_unique_customers"),
        repeat_rows.cast("bigint").alias("repeat_customers"),
        pct(repeat_rows, F.count("customer_unique_id")).alias("retention_rate_pct"),
    )


def overall_retention_by_person(t: Tables, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> DataFrame:
    """Corrected retention: persons with two or more kept orders over persons."""
    counts = person_orders(t, excluded).where(F.col("customer_unique_id").isNotNull())
    repeat = sum_if(F.col("total_orders") >= 2)
    return counts.agg(
        F.count(F.lit(1)).alias("total_unique_customers"),
        repeat.cast("bigint").alias("repeat_customers"),
        pct(repeat, F.count(F.lit(1))).alias("retention_rate_pct"),
    )
