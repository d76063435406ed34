"""Load coercions, collation, join losses and heavy hitters on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import SF001

from marketlens.operators import quality, revenue
from marketlens.sources import ledger
from marketlens.sources.schemas import SCHEMAS
from marketlens.sources.tables import from_rows
from marketlens.sources.testdata import from_testdata

TS = dt.datetime(2018, 1, 1)


def _strings(spark, table, rows):
    return spark.createDataFrame(rows, ", ".join(f"{f.name} string" for f in SCHEMAS[table]))


PAYMENTS = [
    ("o1", "1", "credit_card", "3", "10.50"),
    ("o2", "", "voucher", " ", "abc"),
    ("o3", "1.5", "x" * 21, "9999999999", "123456789.00"),
    ("o4", None, None, "-2147483648", "99999999.994"),
    ("o5", "2", "boleto", "two", "99999999.995"),
]


def test_each_field_fails_for_one_reason(spark):
    got = {tuple(r) for r in ledger.coercion_counts({"payments": _strings(spark, "payments", PAYMENTS)}).collect()}
    assert got == {
        ("payments", "payment_sequential", "blank", 2),
        ("payments", "payment_sequential", "not_whole", 1),
        ("payments", "payment_type", "too_wide", 1),
        ("payments", "payment_installments", "blank", 1),
        ("payments", "payment_installments", "out_of_range", 1),
        ("payments", "payment_installments", "not_a_number", 1),
        ("payments", "payment_value", "not_a_number", 1),
        ("payments", "payment_value", "out_of_range", 2),
    }


def test_coerced_rows(spark):
    rows = _strings(spark, "payments", PAYMENTS)
    lenient = [tuple(r)[1:5] for r in ledger.coerce(rows, "payments").collect()]
    assert lenient == [(1, "credit_card", 3, D("10.50")), (None, "voucher", None, None), (None, None, None, None), (None, None, -(2**31), D("99999999.99")), (2, "boleto", None, None)]
    server = [tuple(r)[1:5] for r in ledger.coerce(rows, "payments", as_server=True).collect()]
    assert server == [(1, "credit_card", 3, D("10.50")), (0, "voucher", 0, D("0.00")), (2, "x" * 20, 2**31 - 1, D("99999999.99")), (0, None, -(2**31), D("99999999.99")), (2, "boleto", 0, D("99999999.99"))]
    masks = [r[ledger.MASK] for r in ledger.coerce(rows, "payments").collect()]
    bits = ledger.bits("payments")
    assert masks[0] == 0 and {bits[i] for i in range(len(bits)) if masks[1] >> i & 1} == {("payment_sequential", "blank"), ("payment_installments", "blank"), ("payment_value", "not_a_number")}


def test_dates_and_the_mask_of_a_row(spark):
    rows = [("r1", "o1", "5", "t", "m", "2018-01-01 00:00:00", "2018-02-30 10:00:00"), ("r2", "o2", "4", None, None, "", "0000-00-00 00:00:00")]
    strings = _strings(spark, "reviews", rows)
    got = {tuple(r) for r in ledger.coercion_counts({"reviews": strings}).collect()}
    assert got == {("reviews", "review_answer_timestamp", "bad_date", 2), ("reviews", "review_creation_date", "blank", 1)}
    assert [r.review_creation_date for r in ledger.coerce(strings, "reviews").collect()] == [TS, None]


def test_csv_fields_are_read_as_written(spark, tmp_path):
    path = str(tmp_path / "payments.csv")
    with open(path, "w") as f:
        f.write('order_id,n,type,inst,value\n"o1",1,"a ""quoted"", type",x,1.25\no2,,voucher,2,\n')
    got = {tuple(r) for r in ledger.coercion_counts_of_csv(spark, {"payments": path}).collect()}
    assert got == {("payments", "payment_installments", "not_a_number", 1), ("payments", "payment_sequential", "blank", 1), ("payments", "payment_value", "blank", 1)}
    assert ledger.coerce(ledger.read_strings(spark, "payments", path), "payments").first().payment_type == 'a "quoted", type'


def test_clean_tables_have_only_missing_fields(spark):
    t = from_testdata(spark, SF001)
    found = ledger.coercion_counts(ledger.strings_of(t)).collect()
    nulls = {(r.table_name, r.column_name): r.null_values for r in quality.blank_value_audit(t).collect()}
    assert found and all(r.reason == "blank" and nulls[r.table_name, r.column_name] == r.rows for r in found)
    assert len(ledger.bits("products")) < 63 and ledger.coercion_counts({n: df.limit(0) for n, df in ledger.strings_of(t).items()}).count() == 0


# ---------------------------------------------------------------- collation

@pytest.fixture(scope="module")
def spelled(spark):
    statuses = ["canceled", "Canceled", "CANCELED", "delivered", "délivered", "shipped", None, "Shipped", "shipped"]
    return from_rows(
        spark,
        orders=[(f"o{i}", f"c{i}", s, TS, None, None, None, None) for i, s in enumerate(statuses)],
        customers=[(f"c{i}", f"u{i}", "Z", city, "S") for i, city in enumerate(["São Paulo", "sao paulo", "SAO PAULO", "Rio", "Rio"])],
        order_items=[(f"o{i}", 1, "p", "s", TS, D("10.00"), D("1.00")) for i in range(9)],
        sellers=[("s", "Z", "c", "S")],
        products=[("p", "cat", 1, 1, 1, 1, 1, 1, 1)],
    )


def test_spellings_that_merge(spelled):
    got = {(r.table_name, r.column_name): (r.distinct_values, r.distinct_under_collation, r.merged_groups, r.merged_rows) for r in quality.collation_audit(spelled).collect()}
    assert got["orders", "order_status"] == (7, 3, 3, 8)
    assert got["customers", "customer_city"] == (4, 2, 1, 3)
    assert got["customers", "customer_state"] == (1, 1, 0, 0)


def test_statuses_under_a_collation(spelled):
    plain = {r.order_status: r.total_orders for r in revenue.order_status_breakdown(spelled).collect()}
    assert len(plain) == 8
    got = {r.order_status: (r.total_orders, r.percentage_of_all_orders) for r in revenue.order_status_breakdown(spelled, collation="UNICODE_CI_AI").collect()}
    assert got == {"CANCELED": (3, 33.33), "Shipped": (3, 33.33), "delivered": (2, 22.22), None: (1, 11.11)}
    assert len(revenue.order_status_breakdown(spelled, collation="UTF8_LCASE").collect()) == 5


def test_every_job_compares_under_the_collation(spelled):
    one = revenue.seller_cancellation_ranking(spelled).first()
    assert one.cancelled_orders == 1
    assert revenue.seller_cancellation_ranking(quality.collated(spelled)).first().cancelled_orders == 3
    assert revenue.status_rollup(quality.collated(spelled)).count() == 4
    assert quality.collated(spelled).orders.where("order_status = 'CANCELÉD'").count() == 3


# ---------------------------------------------------------------- join losses

def test_rows_lost_in_joins(spark):
    t = from_rows(
        spark,
        orders=[("o1", "c1", "delivered", TS, None, None, None, None), ("o2", "c9", "delivered", TS, None, None, None, None), ("o3", "c1", "canceled", TS, None, None, None, None), ("o4", None, None, TS, None, None, None, None)],
        customers=[("c1", "u1", "Z", "x", "S"), ("c1", "u1", "Z", "x", "S")],
        order_items=[("o1", 1, "p1", "s1", TS, D("5.00"), D("1.00")), ("o1", 2, "p9", "s1", TS, D("0.00"), D("1.00")), ("o9", 1, "p9", "s9", TS, D("5.00"), D("1.00")), (None, 1, None, None, TS, None, D("1.00"))],
        products=[("p1", "cat", 1, 1, 1, 1, 1, 1, 1)],
        sellers=[("s1", "Z", "c", "S"), ("s1", "Z", "c", "S")],
    )
    got = {(r.statement, r.driving_table, r.step): (r.joined_to, r.rows_in, r.rows_lost) for r in quality.join_loss_by_statement(t).collect()}
    assert got["seller_category_benchmark", "order_items", 1] == ("orders", 4, 2)
    assert got["seller_category_benchmark", "order_items", 2] == ("products", 2, 1)
    assert got["seller_category_benchmark", "order_items", 3] == ("sellers", 1, 0)
    assert got["freight_margin_risk_items", "order_items", 1] == ("products", 2, 1)
    assert got["revenue_leakage_by_status", "orders", 1] == ("order_items", 4, 3)
    assert got["rfm_scores", "orders", 1] == ("customers", 2, 1) and got["rfm_scores", "orders", 2] == ("order_items", 1, 0)
    plan = quality.join_loss_by_statement(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [order_id") + plan.count("Relation") <= 4 * 2  # items and orders once each as driving table, and once as parent


def test_heavy_hitters_are_exact(spark):
    t = from_testdata(spark, SF001)
    n = t.order_items.count()
    got = {(r.column_name, r.value): r.rows for r in quality.heavy_hitter_audit(t, share=0.02).collect()}
    want = {(c, r[c]): r["count"] for c in ("product_id", "seller_id") for r in t.order_items.groupBy(c).count().collect() if r["count"] >= 0.02 * n}
    assert got == want != {}
    assert quality.heavy_hitter_audit(t.replace(order_items=t.order_items.limit(0))).count() == 0
