"""Invariants that hold on any input (checked on the derived sf0.001 tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF001
from marketlens.functions import rules as R
from marketlens.operators import customers, delivery, payments, revenue, sellers
from marketlens.sources.testdata import from_testdata

AS_OF = R.TESTDATA_AS_OF


def _t(spark):
    return from_testdata(spark, SF001)


def test_status_breakdown_covers_all_orders(spark):
    t = _t(spark)
    rows = revenue.order_status_breakdown(t).collect()
    assert sum(r.total_orders for r in rows) == t.orders.count()
    assert abs(sum(r.percentage_of_all_orders for r in rows) - 100) <= 0.005 * len(rows) + 1e-9


def test_corrected_scorecard_sums_to_100(spark):
    rows = delivery.delivery_scorecard_by_order(_t(spark)).collect()
    assert abs(sum(r.pct_of_delivered for r in rows) - 100) <= 0.005 * len(rows) + 1e-9


def test_segment_sizes_cover_rfm_base(spark):
    t = _t(spark)
    assert sum(r.total_customers for r in customers.rfm_segment_summary(t, AS_OF).collect()) == customers.rfm_base(t, AS_OF).count()


def test_cohorts(spark):
    t = _t(spark)
    rows = customers.cohort_retention(t).collect()
    assert all(r.active_customers == r.cohort_size for r in rows)
    c12 = customers.overall_retention_by_person(t).first()
    assert c12.total_unique_customers == sum(r.cohort_size for r in rows)
    assert c12.repeat_customers == sum(r.returned_for_2nd_order for r in rows)


def test_critical_items_bounded(spark):
    assert all(r.critical_items <= r.total_items for r in revenue.category_margin_risk(_t(spark), k=None).collect())


def test_invariant_under_permutation_and_repartitioning(spark):
    t = _t(spark)
    shuffled = t.replace(**{
        name: df.repartition(7).sortWithinPartitions(F.col(df.columns[0]).desc())
        for name, df in t.as_dict().items()
    })
    for job in (
        revenue.revenue_leakage_by_status,
        revenue.category_margin_risk,
        sellers.seller_classification_summary,
        payments.payment_risk_tiers,
        lambda x: customers.rfm_segment_summary(x, AS_OF),
        lambda x: customers.rfm_segments(x, AS_OF),
        delivery.late_delivery_orders,
    ):
        assert sorted(job(t).collect()) == sorted(job(shuffled).collect())


def test_parity_equals_corrected_with_one_review_per_order(spark):
    t = _t(spark)
    one_review = t.orders.select(
        F.concat(F.lit("r"), F.col("order_id")).alias("review_id"),
        "order_id",
        (F.length("order_id") % 5 + 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("order_purchase_timestamp").alias("review_creation_date"),
        F.col("order_purchase_timestamp").alias("review_answer_timestamp"),
    )
    u = t.replace(reviews=one_review)
    p07 = sorted((r.delivery_tier, r.total_orders, r.pct_of_delivered, r.avg_review_score) for r in delivery.delivery_scorecard(u).collect())
    c07 = sorted((r.delivery_tier, r.total_orders, r.pct_of_delivered, r.avg_review_score) for r in delivery.delivery_scorecard_by_order(u).collect())
    assert p07 == c07
    p18 = sorted(tuple(r) for r in payments.payment_risk_tiers(u).collect())
    c18 = sorted(tuple(r) for r in payments.payment_risk_by_payment(u).collect())
    assert p18 == c18
    assert sorted(sellers.seller_classification(u, min_orders=1, k=None).collect()) == sorted(
        sellers.seller_classification_by_order(u, min_orders=1, k=None).collect()
    )


def test_executive_summary_equals_separate_reports(spark):
    from marketlens.operators import report

    t = _t(spark)
    kpis, recs, cards = report.executive_summary(t, AS_OF)
    assert sorted(kpis.collect()) == sorted(report.kpi_dashboard(t, AS_OF).collect())
    assert sorted(recs.collect()) == sorted(report.recommendations(t, AS_OF).collect())
    assert sorted(cards.collect()) == sorted(report.dashboard_cards(t, AS_OF).collect())
    assert kpis.count() == 25 and recs.count() == 8 and cards.count() == 24
