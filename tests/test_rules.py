"""Hand-made boundary rows for every CASE arm (literal expectations, no oracle)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marketlens.functions import rules as R
from marketlens.operators import customers, delivery, payments, revenue, sellers
from marketlens.sources.tables import from_rows

TS = dt.datetime(2018, 1, 1)


def order(oid, cid="c1", status="delivered", purchase=TS, delivered=None, estimated=None):
    return (oid, cid, status, purchase, None, None, delivered, estimated)


def item(oid, price, freight=D("1.00"), product="p1", seller="s1", line=1):
    return (oid, line, product, seller, TS, price, freight)


def review(oid, score, rid=None):
    return (rid or f"r-{oid}-{score}", oid, score, None, None, TS, TS)


def payment(oid, inst, value, ptype="credit_card", seq=1):
    return (oid, seq, ptype, inst, value)


PRODUCT = ("p1", "cat", 10, 10, 1, 100, 1, 1, 1)
SELLER = ("s1", "Z1", "city_1", "S1")


def labels(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v " + ("int" if isinstance(values[0], int) else "double"))
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_freight_ladder(spark):
    freights = ["10.00", "9.99", "7.50", "7.49", "5.00", "4.99"]
    t = from_rows(
        spark,
        order_items=[item(f"o{i}", D("10.00"), D(f)) for i, f in enumerate(freights)],
        products=[PRODUCT],
        sellers=[SELLER],
    )
    got = {r.order_id: r.margin_risk_category for r in revenue.freight_margin_risk_items(t, k=None).collect()}
    want = [R.FREIGHT_CRITICAL, R.FREIGHT_HIGH, R.FREIGHT_HIGH, R.FREIGHT_MODERATE, R.FREIGHT_MODERATE, R.FREIGHT_OK]
    assert [got[f"o{i}"] for i in range(6)] == want


def test_price_guard_drops_zero_and_null(spark):
    t = from_rows(
        spark,
        order_items=[item("o0", D("0.00")), item("o1", None), item("o2", D("5.00"))],
        products=[PRODUCT],
        sellers=[SELLER],
    )
    assert [r.order_id for r in revenue.freight_margin_risk_items(t, k=None).collect()] == ["o2"]
    assert revenue.category_margin_risk(t, k=None).count() == 0  # freight 1.00 < price 5.00: no critical item


def test_delivery_ladder_and_guards(spark):
    est = dt.datetime(2018, 1, 10)
    delivered = [
        dt.datetime(2018, 1, 10, 0, 0),
        dt.datetime(2018, 1, 10, 0, 1),
        dt.datetime(2018, 1, 17),
        dt.datetime(2018, 1, 18),
        dt.datetime(2018, 2, 9),
        dt.datetime(2018, 2, 10),
    ]
    rows = [order(f"o{i}", delivered=d, estimated=est) for i, d in enumerate(delivered)]
    rows += [order("shipped", status="shipped", delivered=est, estimated=est), order("nodate", estimated=est)]
    t = from_rows(spark, orders=rows)
    got = {r.order_id: (r.days_late, r.delivery_status) for r in delivery.late_delivery_orders(t, k=None).collect()}
    assert [got[f"o{i}"] for i in range(6)] == [
        (0, R.DELIVERY_ON_TIME),
        (0, R.DELIVERY_SLIGHT),
        (7, R.DELIVERY_SLIGHT),
        (8, R.DELIVERY_VERY),
        (30, R.DELIVERY_VERY),
        (31, R.DELIVERY_CRITICAL),
    ]
    assert "shipped" not in got and "nodate" not in got


def test_rfm_score_ladders(spark):
    rule = R.RfmRule()
    assert labels(spark, [-5, 90, 91, 180, 181, 270, 271], rule.recency_score) == [4, 4, 3, 3, 2, 2, 1]
    assert labels(spark, [1, 2, 3, 9], rule.frequency_score) == [2, 3, 4, 4]
    assert labels(spark, [99.99, 100.0, 199.99, 200.0, 499.99, 500.0], rule.monetary_score) == [1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize(
    "days,orders,spend,a,b",
    [
        (200, 2, 50, R.SEG_AT_RISK, R.SEG_LOST),
        (300, 1, 250, R.SEG_CANNOT_LOSE, R.SEG_LOST),
        (300, 1, 500, R.SEG_CANNOT_LOSE, R.SEG_CANNOT_LOSE),
        (300, 2, 500, R.SEG_LOYAL, R.SEG_LOYAL),
        (10, 1, 500, R.SEG_CHAMPION, R.SEG_CHAMPION),
        (100, 1, 50, R.SEG_PROMISING, R.SEG_PROMISING),
        (300, 3, 150, R.SEG_AT_RISK, R.SEG_AT_RISK),
    ],
)
def test_segment_rule_sets(spark, days, orders, spend, a, b):
    rule = R.RfmRule()
    df = spark.createDataFrame([(days, orders, float(spend))], "d int, n long, m double")
    rs, fs, ms = rule.recency_score(F.col("d")), rule.frequency_score(F.col("n")), rule.monetary_score(F.col("m"))
    row = df.select(
        R.SegmentRuleA().label(rs, fs, ms).alias("a"),
        R.SegmentRuleB().label(rs, fs, ms, F.col("d"), F.col("n"), F.col("m")).alias("b"),
    ).first()
    assert (row.a, row.b) == (a, b)


@pytest.mark.parametrize(
    "rev,review,cancel,want",
    [
        (100000.01, 4.00, 0.0, R.SELLER_ELITE),
        (100000.01, 3.70, 0.0, R.SELLER_AVERAGE),
        (100000.01, 3.69, 0.0, R.SELLER_QUALITY_RISK),
        (100000.01, 3.80, 5.01, R.SELLER_HIGH_CANCEL),
        (100000.00, 4.00, 0.0, R.SELLER_HIDDEN_GEM),
        (50000.00, 4.00, 0.0, R.SELLER_HIDDEN_GEM),
        (50000.00, 4.20, 0.0, R.SELLER_HIDDEN_GEM),
        (49999.99, 4.20, 0.0, R.SELLER_UNDERMONETISED),
        (10000.00, 4.20, 0.0, R.SELLER_UNDERMONETISED),
        (9999.99, 4.20, 0.0, R.SELLER_AVERAGE),
        (500.0, None, 5.00, R.SELLER_AVERAGE),
        (500.0, None, 5.01, R.SELLER_HIGH_CANCEL),
    ],
)
def test_seller_ladder(spark, rev, review, cancel, want):
    df = spark.createDataFrame([(rev, review, cancel)], "rv double, rs double, cr double")
    got = df.select(R.SellerRule().label(F.col("rv"), F.col("rs"), F.col("cr"))).first()[0]
    assert got == want


def test_payment_ladder_and_filter(spark):
    rows = [
        payment("o1", 10, D("300.00")),
        payment("o2", 10, D("299.99")),
        payment("o3", 10, D("199.99")),
        payment("o4", 10, D("99.99")),
        payment("o5", 1, D("9999.00")),
        payment("o6", 2, D("9999.00")),
        payment("o7", 0, D("10.00")),
        payment("o8", 1, D("10.00"), ptype="voucher"),
    ]
    t = from_rows(spark, payments=rows)
    got = {r.payment_risk_tier: r.total_orders for r in payments.payment_risk_tiers(t).collect()}
    assert got == {R.PAY_HIGH: 1, R.PAY_MEDIUM: 1, R.PAY_LOW: 1, R.PAY_MINIMAL: 2, R.PAY_NONE: 1}


def test_status_filter_drops_cancelled_unavailable_and_null(spark):
    t = from_rows(
        spark,
        customers=[(f"c{i}", "u1", "Z", "c", "S") for i in range(4)],
        orders=[order("o0", "c0", "canceled"), order("o1", "c1", "unavailable"), order("o2", "c2", None), order("o3", "c3")],
        order_items=[item(f"o{i}", D("10.00")) for i in range(4)],
    )
    row = customers.rfm_base(t, "2018-01-31").first()
    assert (row.frequency, row.monetary, row.recency_days) == (1, 10.0, 30)


def test_fanout_kept_and_corrected(spark):
    t = from_rows(
        spark,
        orders=[order("o1")],
        order_items=[item("o1", D("10.00"))],
        products=[PRODUCT],
        sellers=[SELLER],
        reviews=[review("o1", 1), review("o1", 5)],
    )
    p13 = sellers.seller_category_benchmark(t, min_orders=1, k=None).first()
    assert (p13.total_revenue, p13.avg_review_score, p13.total_orders) == (20.0, 3.0, 1)
    c14 = sellers.seller_base_by_order(t, min_orders=1).first()
    assert c14.total_revenue == 10.0 and c14.avg_review_score == 3.0


def test_cancellation_rate_over_100_percent(spark):
    t = from_rows(
        spark,
        orders=[order("o1", status="canceled")],
        order_items=[item("o1", D("10.00"), line=i) for i in (1, 2, 3)],
        sellers=[SELLER],
    )
    p03 = revenue.seller_cancellation_ranking(t).first()
    assert (p03.cancelled_orders, p03.cancellation_rate_pct, p03.revenue_lost_to_cancellations) == (3, 300.0, 30.0)
    c03 = revenue.seller_cancellation_by_order(t).first()
    assert (c03.cancelled_orders, c03.cancellation_rate_pct) == (1, 100.0)


def test_retention_row_grain(spark):
    t = from_rows(
        spark,
        customers=[("c1", "u1", "Z", "c", "S"), ("c2", "u1", "Z", "c", "S"), ("c3", "u1", "Z", "c", "S"), ("c4", "u2", "Z", "c", "S")],
        orders=[order("o1", "c1"), order("o2", "c2"), order("o3", "c3"), order("o4", "c4")],
    )
    p12 = customers.overall_retention(t).first()
    assert (p12.total_unique_customers, p12.repeat_customers, p12.retention_rate_pct) == (2, 3, 150.0)
    c12 = customers.overall_retention_by_person(t).first()
    assert (c12.total_unique_customers, c12.repeat_customers, c12.retention_rate_pct) == (2, 1, 50.0)


def test_percent_base_is_unjoined(spark):
    est = dt.datetime(2018, 1, 10)
    t = from_rows(spark, orders=[order("o1", delivered=est, estimated=est)], reviews=[review("o1", 4), review("o1", 5, "r2")])
    p07 = delivery.delivery_scorecard(t).first()
    assert (p07.total_orders, p07.pct_of_delivered) == (2, 200.0)
    c07 = delivery.delivery_scorecard_by_order(t).first()
    assert (c07.total_orders, c07.pct_of_delivered) == (1, 100.0)


def test_half_cent_rounds_half_up(spark):
    t = from_rows(spark, orders=[order("o1")], order_items=[item("o1", D("0.14")), item("o1", D("0.15"), line=2)])
    assert revenue.revenue_leakage_by_status(t).first().avg_order_value == 0.15


# ---------------------------------------------------------------- thresholds other than the published ones

def test_published_thresholds_give_published_labels():
    assert R.DeliveryRule().names() == R.DELIVERY_LABELS


def test_delivery_labels_follow_the_thresholds(spark):
    rule = R.DeliveryRule(slight_days=3, very_days=10)
    est = dt.datetime(2018, 1, 10)
    t = from_rows(spark, orders=[order(f"o{d}", delivered=est + dt.timedelta(days=d), estimated=est) for d in (0, 3, 4, 10, 11)])
    got = {r.order_id: r.delivery_status for r in delivery.late_delivery_orders(t, rule, k=None).collect()}
    assert got == {
        "o0": "on time",
        "o3": "slightly late (1-3 days)",
        "o4": "very late (4-10 days)",
        "o10": "very late (4-10 days)",
        "o11": "critically late (10+ days)",
    }
    tiers = [r.delivery_tier for r in delivery.delivery_scorecard(t, rule).collect()]
    assert tiers == [f"{i} — {n}" for i, n in enumerate(rule.names(), 1)]


def test_frequency_ladder_rises_for_other_thresholds(spark):
    assert labels(spark, [0, 1, 2, 3, 4, 5, 6], R.RfmRule(frequency_orders=(5, 3, 1)).frequency_score) == [1, 2, 2, 3, 3, 4, 4]


def test_other_recency_and_spend_ladders(spark):
    rule = R.RfmRule(recency_days=(10, 20, 30), monetary=(50.5, 20.25, 1))
    assert labels(spark, [10, 11, 20, 21, 30, 31], rule.recency_score) == [4, 3, 3, 2, 2, 1]
    assert labels(spark, [50.5, 50.49, 20.25, 20.24, 1.0, 0.99], rule.monetary_score) == [4, 3, 3, 2, 2, 1]


def test_freight_thresholds_keep_their_digits(spark):
    rule = R.FreightRule(high_share=0.5005, moderate_share=0.334)
    items = [item(f"o{f}", D("1000.00"), D(f)) for f in ("332.00", "335.00", "500.40", "500.50")]
    t = from_rows(spark, order_items=items, products=[PRODUCT], sellers=[SELLER])
    got = {r.order_id: r.margin_risk_category for r in revenue.freight_margin_risk_items(t, rule, k=None).collect()}
    assert got == {"o332.00": R.FREIGHT_OK, "o335.00": R.FREIGHT_MODERATE, "o500.40": R.FREIGHT_MODERATE, "o500.50": R.FREIGHT_HIGH}


def test_payment_thresholds_keep_their_digits(spark):
    rule = R.PaymentRiskRule(high=(4, 100.005), medium=(2, 50.555), low=(2, 10.0))
    t = from_rows(spark, payments=[payment("a", 4, D("100.01")), payment("b", 4, D("100.00")), payment("c", 2, D("50.55")), payment("d", 2, D("50.56"))])
    got = {r.payment_risk_tier: r.total_orders for r in payments.payment_risk_tiers(t, rule).collect()}
    assert got == {R.PAY_HIGH: 1, R.PAY_MEDIUM: 2, R.PAY_LOW: 1}


@pytest.mark.parametrize(
    "scores,rule,want",
    [
        ((4, 1, 1), R.SegmentRuleA(promising_recency=4), R.SEG_PROMISING),
        ((3, 1, 1), R.SegmentRuleA(promising_recency=4), R.SEG_LOST),
        ((1, 2, 1), R.SegmentRuleA(at_risk_frequency=2), R.SEG_AT_RISK),
        ((2, 1, 2), R.SegmentRuleA(cannot_lose_recency=2, cannot_lose_monetary=2), R.SEG_CANNOT_LOSE),
        ((2, 2, 2), R.SegmentRuleA(champion_total=6), R.SEG_CHAMPION),
        ((2, 2, 1), R.SegmentRuleA(loyal_total=5), R.SEG_LOYAL),
    ],
)
def test_segment_a_arms(spark, scores, rule, want):
    df = spark.createDataFrame([scores], "r int, f int, m int")
    assert df.select(rule.label(F.col("r"), F.col("f"), F.col("m"))).first()[0] == want


@pytest.mark.parametrize(
    "days,orders,spend,rule,want",
    [
        (30, 2, 1.0, R.SegmentRuleB(promising_orders=2), R.SEG_PROMISING),
        (31, 1, 1.0, R.SegmentRuleB(promising_days=30), R.SEG_LOST),
        (50, 2, 1.0, R.SegmentRuleB(cold_days=40, at_risk_orders=2, promising_days=10), R.SEG_AT_RISK),
        (300, 1, 99.0, R.SegmentRuleB(cannot_lose_spend=99), R.SEG_CANNOT_LOSE),
    ],
)
def test_segment_b_arms(spark, days, orders, spend, rule, want):
    df = spark.createDataFrame([(1, 1, 1, days, orders, spend)], "r int, f int, m int, d int, n long, s double")
    assert df.select(rule.label(*(F.col(c) for c in "rfmdns"))).first()[0] == want


def test_seller_thresholds(spark):
    rule = R.SellerRule(elite_revenue=10, good_review=3, risky_review=2, gem_revenue_low=5, niche_revenue_low=2, niche_review=4, cancel_rate=1)
    rows = [(11.0, 3.0, 0.0), (11.0, 1.9, 0.0), (10.0, 3.0, 0.0), (5.0, 2.9, 0.0), (4.0, 4.0, 0.0), (1.0, 5.0, 1.1), (1.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r[0] for r in df.select(rule.label(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [R.SELLER_ELITE, R.SELLER_QUALITY_RISK, R.SELLER_HIDDEN_GEM, R.SELLER_AVERAGE, R.SELLER_UNDERMONETISED, R.SELLER_HIGH_CANCEL, R.SELLER_AVERAGE]


def test_the_largest_legal_freight_share(spark):
    """Price 0.01 with freight 10,000.00: 100,000,000 per cent."""
    from marketlens.operators import report

    t = from_rows(spark, orders=[order("o1")], order_items=[item("o1", D("0.01"), D("10000.00"))], products=[PRODUCT], sellers=[SELLER])
    row = revenue.category_margin_risk(t).first()
    assert row.avg_freight_pct == 100_000_000.0 and row.total_money_lost == 9999.99
    for job in (report.kpi_dashboard, report.recommendations, report.dashboard_cards):
        assert job(t).count() > 0
