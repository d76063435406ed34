"""The derived eight tables reproduce the published fixture counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF001, SF01
from marketlens.functions import rules as R
from marketlens.operators import customers, delivery, payments, revenue, sellers
from marketlens.sources.testdata import from_testdata

EXPECTED = {
    "sf0.001": dict(customers=1500, orders=1500, order_items=6000, products=200, sellers=17, payments=1589, reviews=1432, geolocation=50),
    "sf0.01": dict(customers=15000, orders=15000, order_items=60000, products=2000, sellers=159, payments=15883, reviews=14324, geolocation=50),
}


def test_row_counts(spark):
    for sf_dir in (SF001, SF01):
        t = from_testdata(spark, sf_dir)
        want = EXPECTED[sf_dir.rsplit("/", 1)[-1]]
        got = {name: df.count() for name, df in t.as_dict().items()}
        assert got == want


def test_fixture_checks_sf001(spark):
    t = from_testdata(spark, SF01)
    assert t.customers.select("customer_unique_id").distinct().count() == 7952
    assert t.orders.join(t.order_items, "order_id", "left_anti").count() == 257
    assert t.reviews.groupBy("order_id").count().where("count > 1").count() == 478
    delivered = t.orders.where(F.col("order_status") == "delivered")
    assert delivered.where(F.col("order_delivered_customer_date").isNull()).count() == 116

    tiers = {r[0]: r[1] for r in delivery.delivery_scorecard_by_order(t).select("delivery_tier", "total_orders").collect()}
    assert [tiers[k] for k in sorted(tiers)] == [10122, 68, 403, 541]

    base = customers.rfm_base(t, R.TESTDATA_AS_OF)
    by_freq = {r[0]: r[1] for r in base.groupBy("frequency").count().collect()}
    assert [by_freq[i] for i in range(1, 8)] == [3685, 2400, 978, 344, 75, 15, 2]

    a = {r[0]: r[1] for r in customers.rfm_segments(t, R.TESTDATA_AS_OF, k=None).groupBy("customer_segment").count().collect()}
    b = {r[0]: r[1] for r in customers.rfm_segment_summary(t, R.TESTDATA_AS_OF).select("customer_segment", "total_customers").collect()}
    order = [R.SEG_CHAMPION, R.SEG_LOYAL, R.SEG_PROMISING, R.SEG_AT_RISK, R.SEG_CANNOT_LOSE, R.SEG_LOST]
    assert [a[s] for s in order] == [681, 2716, 86, 584, 1927, 1505]
    assert [b[s] for s in order] == [681, 2716, 86, 35, 1511, 2470]

    cls = {r[0]: r[1] for r in sellers.seller_classification_summary(t).select("seller_classification", "total_sellers").collect()}
    order = [R.SELLER_ELITE, R.SELLER_QUALITY_RISK, R.SELLER_HIDDEN_GEM, R.SELLER_UNDERMONETISED, R.SELLER_HIGH_CANCEL, R.SELLER_AVERAGE]
    assert [cls[s] for s in order] == [20, 3, 14, 20, 54, 48]

    pay = {r[0]: r[1] for r in t.payments.groupBy("payment_type").count().collect()}
    assert [pay[s] for s in ("credit_card", "bank_slip", "voucher", "debit_card")] == [11250, 1500, 2383, 750]
    risk = {r[0]: r[1] for r in payments.payment_risk_tiers(t).select("payment_risk_tier", "total_orders").collect()}
    assert [risk[s] for s in (R.PAY_HIGH, R.PAY_MEDIUM, R.PAY_LOW, R.PAY_NONE, R.PAY_MINIMAL)] == [1083, 2822, 3532, 980, 2881]

    items = revenue.freight_margin_risk_items(t, k=None)
    freight = {r[0]: r[1] for r in items.groupBy("margin_risk_category").count().collect()}
    assert [freight[s] for s in (R.FREIGHT_CRITICAL, R.FREIGHT_HIGH, R.FREIGHT_MODERATE, R.FREIGHT_OK)] == [18585, 6223, 7456, 27441]

    p12 = customers.overall_retention(t).first()
    assert (p12.total_unique_customers, p12.repeat_customers, p12.retention_rate_pct) == (7556, 10394, 137.56)
    c12 = customers.overall_retention_by_person(t).first()
    assert (c12.total_unique_customers, c12.repeat_customers, c12.retention_rate_pct) == (7556, 3893, 51.52)
    assert customers.cohort_retention(t).count() == 79
    assert sellers.seller_category_benchmark(t, k=None).count() == 2422


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 6
    assert {r.customer_segment: r.total_customers for r in rows} == {
        R.SEG_CHAMPION: 64, R.SEG_LOYAL: 269, R.SEG_PROMISING: 11, R.SEG_AT_RISK: 4, R.SEG_CANNOT_LOSE: 164, R.SEG_LOST: 243,
    }
