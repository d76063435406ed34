"""Plans whose tasks hold little at any size of the tables, and the same results with odd keys."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import functions as F

from marketlens.operators import payments, quality, report, sellers, summary
from marketlens.operators.common import review_stats
from marketlens.sources import ledger
from marketlens.sources.tables import from_rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


DAY = dt.datetime(1998, 1, 1)


def _order(number: int | None, status: str = "delivered", customer: str | None = "c1") -> tuple:
    return (None if number is None else f"o{number}", customer, status, DAY, None, None, None, None)


def _item(order: int | None, seller: str | None, price: str | None = "10.00", product: str | None = "p1") -> tuple:
    return (None if order is None else f"o{order}", 1, product, seller, DAY, None if price is None else Decimal(price), None)


def test_orphans_are_counted_without_a_join(spark):
    t = from_rows(
        spark,
        customers=[("c1", "u1", "Z" * 11, "x", "long state"), ("c1", "u1", "Z", "x", "S"), (None, "u2", "Z", "x", "S")],
        orders=[_order(1), _order(1), _order(2, customer="c9"), _order(None, customer=None), _order(3, "s" * 21)],
        order_items=[_item(1, "A"), _item(1, "B", product=None), _item(7, "A"), _item(7, "A"), _item(None, "A", product="p" * 51)],
        payments=[("o1", 1, "voucher", 1, None), ("o8", 1, "voucher", 1, None)],
        reviews=[("r", "o7", 1, None, None, None, None)],
        products=[("p1", *[None] * 8)],
        sellers=[("A", "Z", "x", "S")],
    )
    audit = quality.orphan_and_length_audit(t)
    assert "Join" not in _plan(audit)
    rows = audit.collect()
    assert len(rows) == 31 and [tuple(x)[:3] for x in rows] == sorted(tuple(x)[:3] for x in rows)
    assert {(x.table_name, x.column_name, x.rule): x.violations for x in rows if x.violations} == {
        ("orders", "customer_id", "customers.customer_id"): 2,
        ("order_items", "order_id", "orders.order_id"): 3,
        ("order_items", "product_id", "products.product_id"): 2,
        ("order_items", "seller_id", "sellers.seller_id"): 1,
        ("payments", "order_id", "orders.order_id"): 1,
        ("reviews", "order_id", "orders.order_id"): 1,
        ("customers", "customer_zip_code_prefix", "length <= 10"): 1,
        ("customers", "customer_state", "length <= 5"): 1,
        ("orders", "order_status", "length <= 20"): 1,
        ("order_items", "product_id", "length <= 50"): 1,
    }


ODD_TIMES = ["1998-02-28 02:30:00", "1998-02-30 00:00:00", "0000-00-00 00:00:00", "0000-01-01 00:00:00", "1998-1-2 00:00:00", "1998-01-01", "1998-01-01T00:00:00",
             "1998-01-01 24:00:00", "1998-01-01 00:00:60", "1998-01-01 00:00:1Z", "+12345-01-01 00:00:00", "1998-01-01 00:00:00\n", "1998-01-01 00:00:00.5", "", "  ", "yesterday", None]
ODD_NUMBERS = ["1", "-1", "007", "999999999", "2147483647", "2147483648", "-2147483648", "-2147483649", "1.0", "1.5", "+3", "1e3", "99999999.99", "99999999.995", "9999999.9999999999", "100000000",
               "-99999999.995", ".5", "5.", "1,5", "", " ", " 7 ", "n/a", "٣", "1" * 30, "1" * 40, None]


def test_ledger_tries_each_field_once(spark):
    """A filter on the mask was pushed to the strings, so that every field was tried twice."""
    strings = {"orders": spark.createDataFrame([("o", "c", "s", x, x, x, x, x) for x in ODD_TIMES], "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_approved_at string, order_delivered_carrier_date string, order_delivered_customer_date string, order_estimated_delivery_date string")}
    counts = ledger.coercion_counts(strings)
    assert _plan(counts).count("Filter") == 1  # of bits that are not set
    t = F.coalesce(F.trim("order_purchase_timestamp"), F.lit(""))
    bad = strings["orders"].where(t != "").where(F.try_to_timestamp(t, F.lit(ledger.TIMESTAMP_FORMAT)).isNull()).count()
    assert {(x.column_name, x.reason): x.rows for x in counts.collect()} == {(c, reason): n for c in strings["orders"].columns[3:] for reason, n in (("blank", 3), ("bad_date", bad))}


def test_plain_numbers_count_as_all_numbers_do(spark):
    columns = "order_id string, payment_sequential string, payment_type string, payment_installments string, payment_value string"
    strings = spark.createDataFrame([("o", x, "voucher", "1", x) for x in ODD_NUMBERS], columns)
    got = {(x.column_name, x.reason): x.rows for x in ledger.coercion_counts({"payments": strings}).collect()}
    masks = [x[0] for x in ledger.coerce(strings, "payments").select(ledger.MASK).collect()]
    assert got == {b: n for i, b in enumerate(ledger.bits("payments")) if (n := sum(m >> i & 1 for m in masks))}
    assert got["payment_sequential", "blank"] == 3 and got["payment_value", "not_a_number"] == got["payment_sequential", "not_a_number"]
    assert got["payment_sequential", "not_whole"] == 6 and got["payment_value", "out_of_range"] == 8
    read = {x: (a, b) for x, a, b in zip(ODD_NUMBERS, *zip(*ledger.coerce(strings, "payments").select("payment_sequential", "payment_value").collect()))}
    assert read["007"] == (7, Decimal("7.00")) and read["2147483648"] == (None, None) and read["9999999.9999999999"] == (None, Decimal("10000000.00"))


def _odd_orders(spark):
    """Orders, items and reviews that come twice, without a key, or without each other; sellers without an id."""
    return from_rows(
        spark,
        orders=[_order(1), _order(1), _order(1, "canceled"), _order(2, "canceled"), _order(3), _order(None), _order(4, None)],
        order_items=[_item(1, "A"), _item(1, "A", "5.00", "p2"), _item(1, "B"), _item(2, "A"), _item(2, "A"), _item(3, None), _item(3, "A", None), _item(4, None, "2.00", None), _item(9, "A"), _item(None, "A")],
        reviews=[("r1", "o1", 5, None, None, None, None), ("r1", "o1", 2, None, None, None, None), ("r2", "o2", None, None, None, None, None), ("r3", None, 1, None, None, None, None)],
        products=[("p1", "x", *[None] * 7), ("p1", "x", *[None] * 7), ("p1", "y", *[None] * 7), ("p2", None, *[None] * 7), (None, "z", *[None] * 7)],
        sellers=[("A", "Z", "city", "S"), ("B", "Z", "city", "S"), ("B", "Z", "town", "S"), (None, "Z", "x", "S")],
    )


def test_orders_of_a_seller_are_counted_without_a_table_of_pairs(spark):
    t = _odd_orders(spark)
    jobs = [sellers.seller_classification_by_order(t, min_orders=1), sellers.seller_classification(t, min_orders=1), sellers.seller_category_benchmark(t, min_orders=1), sellers.seller_sums(t), report.kpi_dashboard(t)]
    for job in jobs:
        assert "keys=[seller_id, order_id" not in (plan := _plan(job).replace("#", " #")).replace(" #", "#").translate({ord(c): None for c in "0123456789#L"}), plan


def test_orders_of_a_seller_are_different_orders(spark):
    t = _odd_orders(spark)
    rows = t.order_items.join(t.orders, "order_id").join(t.products, "product_id", "left")
    want = {tuple(x) for x in rows.groupBy("seller_id").agg(F.countDistinct("order_id")).collect()}
    assert {(x.seller_id, x.total_orders) for x in sellers.seller_sums(t).collect()} == want == {("A", 3), ("B", 1), (None, 2)}
    by_category = rows.join(t.products.select("product_id").distinct(), "product_id").where("seller_id is not null").groupBy("seller_id", "product_category_name").agg(F.countDistinct("order_id"))
    got = {(x.seller_id, x.product_category_name, x.total_orders) for x in sellers.seller_category_benchmark(t, min_orders=1, k=None).collect()}
    assert got == {tuple(x) for x in by_category.collect()} == {("A", "x", 3), ("A", "y", 3), ("A", None, 1), ("B", "x", 1), ("B", "y", 1)}
    base = {x.seller_id: x for x in sellers.seller_base_by_order(t, min_orders=1).collect()}
    assert (base["A"].total_revenue, base["A"].avg_review_score, base["A"].cancellation_rate) == (65.0, 3.5, 133.33)


def test_order_groups_of_the_summary_are_hashed(spark):
    late = lambda number, days: (f"o{number}", "c1", "delivered", DAY, None, None, DAY + dt.timedelta(days=days), DAY)
    t = from_rows(spark, orders=[late(1, 3), late(2, 40), late(3, -2), _order(4)])
    groups = summary._order_groups(t, summary.DEFAULT_RULES)
    assert "SortAggregate" not in _plan(groups)
    worst = {(x.a, x.b): tuple(x.worst) for x in groups.where("kind = 'status'").collect()}
    assert worst["delivered", "1"] == (-2, dt.date(1997, 12, 30)) and worst["delivered", "4"] == (40, dt.date(1998, 2, 10))
    assert worst["delivered", None] == (None, None)


def _payment(order: str | None, kind: str | None, instalments: int | None = 1) -> tuple:
    return (order, 1, kind, instalments, Decimal("5.00"))


def test_paying_orders_are_counted_without_copies_of_the_payments(spark):
    """Two distinct counts expanded every payment to three rows of a hash table."""
    rows = [_payment("o1", "credit_card", 3), _payment("o1", "credit_card", None), _payment("o1", "voucher", 7), _payment("o2", "voucher"), _payment("o2", None), _payment("o3", "credit_card", 2),
            _payment("o3", "credit_card", 2), _payment(None, "credit_card", 4), _payment(None, "voucher")]
    t = from_rows(spark, payments=rows)
    sums = summary._payment_sums(t, summary.DEFAULT_RULES)
    assert [f.dataType.simpleString() for f in sums.schema] == ["bigint"] * 5
    assert [x.asDict() for x in sums.collect()] == [{"credit_orders": 2, "paid_orders": 3, "instalment_sum": 11, "instalment_cnt": 4, "credit_rows": 5}]
    none = summary._payment_sums(from_rows(spark), summary.DEFAULT_RULES)
    assert [tuple(x) for x in none.collect()] == [(0, 0, None, 0, 0)]
    for job in (report.dashboard_cards(t), report.recommendations(t), report.kpi_dashboard(t)):
        assert not re.search(r"Expand \[.*payment_type", _plan(job)) and not re.search(r"keys=\[seller_id#\d+L?, order_id", _plan(job))


def test_reviews_are_summed_by_order_without_a_hash_table_of_orders(spark):
    """Nearly every review is its order's only one, so both steps of the aggregation held them all."""
    review = lambda order, score: ("r", order, score, None, None, None, None)
    rows = [review("o1", 5), review("o1", 5), review("o1", None), review("o1", 2), review("o2", None), review("o2", None), review("o3", 4), review(None, 1), review(None, None)]
    reviews = from_rows(spark, reviews=rows).reviews
    stats = review_stats(reviews)
    assert "Aggregate" not in _plan(stats)
    assert [(f.name, f.dataType.simpleString()) for f in stats.schema] == [("order_id", "string"), ("rv_rows", "bigint"), ("rv_sum", "bigint"), ("rv_cnt", "bigint")]
    want = reviews.groupBy("order_id").agg(F.count(F.lit(1)), F.sum("review_score"), F.count("review_score"))
    got = sorted(map(tuple, stats.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) == [("o1", 4, 12, 3), ("o2", 2, None, 0), ("o3", 1, 4, 1), (None, 2, 1, 1)]
    assert review_stats(reviews.limit(0)).collect() == []
    t = _odd_orders(spark)
    for job in (sellers.seller_classification(t), sellers.seller_classification_by_order(t), sellers.seller_classification_summary(t), sellers.seller_category_benchmark(t), payments.payment_risk_tiers(t)):
        assert not re.search(r"keys=\[order_id#\d+\]", _plan(job)), _plan(job)
