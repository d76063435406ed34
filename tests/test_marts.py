"""Published marts: written when asked, read back in any session, nothing behind a caller's back."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from conftest import SF001

from marketlens.operators import revenue, sellers
from marketlens.plans import registry
from marketlens.sources.marts import bucket_skew, drop_marts, open_marts, publish_marts, suggested_buckets
from marketlens.sources.tables import from_rows
from marketlens.sources.testdata import from_testdata

TS = dt.datetime(2018, 1, 1)


def _tables(spark, hot: bool):
    orders = [(f"o{i}", f"c{i}", "delivered", TS, None, None, None, None) for i in range(40)]
    items = [(f"o{i}", 1, "p1", "s1", TS, D("10.00"), D("2.00")) for i in range(40)]
    if hot:  # one order holds far more than a third of all item rows
        items += [("o0", n, "p1", "s1", TS, D("1.00"), D("2.00")) for n in range(2, 200)]
    return from_rows(
        spark,
        orders=orders,
        order_items=items,
        products=[("p1", "cat", 1, 1, 1, 1, 1, 1, 1)],
        sellers=[("s1", "Z", "c", "S")],
    )


def _is_bucketed(t) -> bool:
    # A bare scan never uses buckets; a per-order aggregate does when they exist.
    plan = t.order_items.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
    return "Bucketed: true" in plan


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("buckets", [None, 4])
def test_layout_is_the_callers_choice(spark, tmp_path, hot, buckets):
    t = _tables(spark, hot)
    root = str(tmp_path / "m")
    m = publish_marts(t, root, buckets)
    assert _is_bucketed(m) == bool(buckets)
    for job in (revenue.revenue_leakage_by_status, lambda x: sellers.seller_category_benchmark(x, min_orders=1)):
        assert sorted(job(m).collect()) == sorted(job(t).collect())
    drop_marts(spark, root)  # the files stay and can be opened again
    assert open_marts(spark, root).order_items.count() == t.order_items.count()
    drop_marts(spark, root)


def test_skew_is_reported(spark):
    assert bucket_skew(_tables(spark, False).order_items, 4) <= 4.0 < bucket_skew(_tables(spark, True).order_items, 8)


def test_suggested_buckets_follow_the_size():
    assert suggested_buckets(10, 8) == 8
    assert suggested_buckets(100 << 40, 8) == (100 << 40) // (256 << 20)


def test_a_failing_publish_raises(spark, tmp_path):
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):
        publish_marts(_tables(spark, False), str(tmp_path / "file" / "below"))


def test_a_query_writes_nothing_and_reads_its_columns(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    before = sorted(os.listdir(root))
    df = registry.QUERIES["order_status_breakdown"](spark, SF001)
    assert df.count() > 0
    assert sorted(os.listdir(root)) == before
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:" in plan and plan.count("FileScan") == plan.count("ReadSchema: struct<o_orderkey:bigint>")


def test_queries_read_named_marts(spark, tmp_path):
    root = str(tmp_path / "m")
    publish_marts(from_testdata(spark, SF001), root)
    want = registry.QUERIES["payment_type_breakdown"](spark, SF001).collect()
    registry.use_marts(SF001, root)
    try:
        got = registry.QUERIES["payment_type_breakdown"](spark, SF001)
        assert root in " ".join(got.inputFiles()) and got.collect() == want
    finally:
        registry.use_marts(SF001, None)
