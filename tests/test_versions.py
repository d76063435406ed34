"""Versions of published marts, months, footers, clustered files, and joins split at hot values."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from marketlens.operators import customers, quality, revenue, sellers
from marketlens.operators.common import hot_keys, split_join, with_hot_keys
from marketlens.sources import marts
from marketlens.sources.marts import footer_count, footer_row_counts, manifest, open_marts, publish_marts, publish_months, vacuum_marts, versions
from marketlens.sources.testdata import from_testdata


@pytest.fixture(scope="module")
def t(spark):
    return from_testdata(spark, SF001)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


# ---------------------------------------------------------------- versions

def test_a_publish_that_fails_in_the_middle_leaves_the_version_before(spark, t, tmp_path):
    root = str(tmp_path / "m")
    publish_marts(t, root)
    want = quality.table_row_counts(open_marts(spark, root)).collect()
    broken = t.reviews.withColumn("review_score", F.when(F.col("review_score") == 5, F.raise_error(F.lit("disk lost"))).otherwise(F.col("review_score")).cast("int"))
    doubled = t.replace(orders=t.orders.union(t.orders), reviews=broken)
    with pytest.raises(Exception, match="disk lost"):
        publish_marts(doubled, root)
    assert versions(spark, root) == [1]
    assert len(os.listdir(f"{root}/data")) == 2  # the failed snapshot lies there, unread
    assert quality.table_row_counts(open_marts(spark, root)).collect() == want
    assert vacuum_marts(spark, root, keep=1) and len(_files(f"{root}/data")) == sum(len(_files(v["path"])) for v in manifest(spark, root)["tables"].values())
    assert quality.table_row_counts(open_marts(spark, root)).collect() == want


def test_open_tables_keep_their_version(spark, t, tmp_path):
    root = str(tmp_path / "m")
    first = publish_marts(t, root)
    before = first.orders.count()
    publish_marts(t.replace(orders=t.orders.where("order_status = 'shipped'")), root)
    assert versions(spark, root) == [1, 2]
    assert first.orders.count() == before == open_marts(spark, root, version=1).orders.count()
    assert 0 < open_marts(spark, root).orders.count() < before
    with pytest.raises(FileNotFoundError):
        open_marts(spark, root, version=7)
    with pytest.raises(FileNotFoundError):
        open_marts(spark, str(tmp_path / "nothing"))
    assert vacuum_marts(spark, root, keep=1) and versions(spark, root) == [2]
    assert 0 < open_marts(spark, root).orders.count() < before


def test_a_number_taken_meanwhile_is_not_overwritten(spark, t, tmp_path, monkeypatch):
    """Two commits at once: the second one takes the next number."""
    root = str(tmp_path / "m")
    publish_marts(t, root)
    real, stale = marts.versions, [[1], [1, 2]]
    marts._commit(spark, root, manifest(spark, root) | {"who": "other"})
    monkeypatch.setattr(marts, "versions", lambda *a: stale.pop(0) if stale else real(*a))
    assert marts._commit(spark, root, manifest(spark, root, None) if not stale else {"tables": {}, "hot": {}}) == 3
    monkeypatch.undo()
    assert versions(spark, root) == [1, 2, 3] and manifest(spark, root, 2)["who"] == "other"


# ---------------------------------------------------------------- months

def test_republishing_a_month_writes_only_that_month(spark, t, tmp_path):
    root = str(tmp_path / "m")
    publish_marts(t, root, by_month=True)
    before = _files(f"{root}/data")
    month = "1995-03"
    changed = open_marts(spark, root, months=(month, month)).orders.withColumn("order_status", F.lit("shipped"))
    n = changed.count()
    assert n > 0
    publish_months(changed, root)
    new = _files(f"{root}/data") - before
    assert new and all(f"purchase_month={month}/" in f for f in new) and before <= _files(f"{root}/data")
    want = t.orders.withColumn("order_status", F.when(F.date_format("order_purchase_timestamp", "yyyy-MM") == month, "shipped").otherwise(F.col("order_status")))
    assert sorted(map(str, open_marts(spark, root).orders.collect())) == sorted(map(str, want.collect()))
    assert open_marts(spark, root, version=1).orders.exceptAll(t.orders).count() == 0
    gone = vacuum_marts(spark, root, keep=1)
    assert [g.rsplit("/", 1)[1] for g in gone] == [f"purchase_month={month}"]
    assert sorted(map(str, open_marts(spark, root).orders.collect())) == sorted(map(str, want.collect()))


def test_a_cohort_range_reads_only_its_months(spark, t, tmp_path):
    root = str(tmp_path / "m")
    publish_marts(t, root, by_month=True)
    part = open_marts(spark, root, months=("1995-01", "1995-03"))
    months = {re.search(r"purchase_month=([^/]+)/", f).group(1) for f in part.orders.inputFiles()}
    assert months == {"1995-01", "1995-02", "1995-03"}
    df = customers.cohort_retention(part)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(3 paths)" in plan
    inside = t.replace(orders=t.orders.where("date_format(order_purchase_timestamp, 'yyyy-MM') between '1995-01' and '1995-03'"))
    assert df.collect() == customers.cohort_retention(inside).collect() != []
    plain = str(tmp_path / "p")
    publish_marts(t, plain)
    assert customers.cohort_retention(open_marts(spark, plain, months=("1995-01", "1995-03"))).collect() == df.collect()
    with pytest.raises(ValueError):
        publish_months(part.orders, plain)


def test_orders_without_a_date_have_a_partition_of_their_own(spark, t, tmp_path):
    root = str(tmp_path / "m")
    undated = t.orders.limit(5).withColumn("order_purchase_timestamp", F.lit(None).cast("timestamp_ntz"))
    publish_marts(t.replace(orders=t.orders.union(undated)), root, by_month=True)
    assert open_marts(spark, root).orders.where("order_purchase_timestamp is null").count() == 5
    assert "" in manifest(spark, root)["tables"]["orders"]["months"]


# ---------------------------------------------------------------- footers, clustered files

@pytest.mark.parametrize("by_month", [False, True])
def test_counts_come_from_the_footers(spark, t, tmp_path, by_month):
    root = str(tmp_path / "m")
    publish_marts(t, root, by_month=by_month)
    assert footer_row_counts(spark, root).collect() == quality.table_row_counts(t).collect()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    path = manifest(spark, root)["tables"]["reviews"]["path"]
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        plan = footer_count(spark, "reviews", [path])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")
    assert "PushedAggregation: [COUNT(*)]" in plan


def _rows_read(df) -> int:
    """Rows that the scans of ``df`` gave out when it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        node = leaves.apply(i)
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan().collectLeaves().apply(0)
        total += node.metrics().apply("numOutputRows").value()
    return total


def test_filters_skip_pages_of_clustered_files(spark, tmp_path):
    t = from_testdata(spark, "/root/testdata/sf0.01")
    root, shuffled = str(tmp_path / "m"), str(tmp_path / "plain")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.page.row.count.limit", "100")  # small pages, as the files are small
    try:
        m = publish_marts(t, root)
        t.orders.repartition(8).write.parquet(shuffled)
    finally:
        conf.unset("parquet.page.row.count.limit")
    n = t.orders.count()
    rows = lambda df: _rows_read(df.where("order_status = 'canceled'").select("order_id"))
    assert rows(m.orders) < n / 4 < n * 0.9 < rows(spark.read.parquet(shuffled))
    job = revenue.order_status_breakdown
    assert job(m).collect() == job(t).collect()
    one = next(iter(_files(manifest(spark, root)["tables"]["orders"]["path"])))
    assert duckdb.execute(f"select count(bloom_filter_offset) from parquet_metadata('{one}') where path_in_schema = 'order_id'").fetchall()[0][0] > 0
    assert len(_files(manifest(spark, root)["tables"]["orders"]["path"])) >= spark.sparkContext.defaultParallelism


# ---------------------------------------------------------------- hot values

@pytest.fixture(scope="module")
def hot(spark, t):
    """A third of all items is sold by one seller, and as much is one product."""
    third = F.pmod(F.xxhash64("order_id", "order_item_id"), F.lit(3)) == 0
    items = t.order_items
    product = items.agg(F.max("product_id")).first()[0]
    seller = t.sellers.agg(F.max("seller_id")).first()[0]
    items = items.withColumn("seller_id", F.when(third, seller).otherwise(F.col("seller_id"))).withColumn("product_id", F.when(third, product).otherwise(F.col("product_id")))
    return t.replace(order_items=items), seller, product


def test_the_sketch_finds_every_hot_value(hot):
    t, seller, product = hot
    n = t.order_items.count()
    for column in ("seller_id", "product_id"):
        counts = {r[column]: r["count"] for r in t.order_items.groupBy(column).count().collect()}
        found = set(hot_keys(t, share=0.02)[column])
        assert {k for k, c in counts.items() if c >= 0.02 * n} <= found <= {k for k, c in counts.items() if c >= 0.015 * n}
    found = hot_keys(t)
    assert seller in found["seller_id"] and product in found["product_id"] and max(map(len, found.values())) <= 201


def test_a_value_with_many_dimension_rows_is_not_broadcast(spark, hot):
    t, seller, _ = hot
    copies = t.sellers.where(F.col("seller_id") == seller).crossJoin(spark.range(150)).drop("id")
    assert seller not in hot_keys(t.replace(sellers=t.sellers.union(copies)))["seller_id"]


@pytest.fixture
def large(spark):
    """As for large tables: no automatic broadcasts, no re-planning that would hide skew."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _largest_task(df) -> float:
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1] / sizes[len(sizes) // 2]


def test_hot_values_leave_no_large_task(large, hot):
    t, seller, product = hot
    for key, dimension in (("seller_id", t.sellers), ("product_id", t.products)):
        columns = dimension.columns[:2]
        plain = t.order_items.join(dimension.select(*columns), key)
        split = split_join(t.order_items, dimension.select(*columns), key, hot_keys(t)[key])
        assert _largest_task(plain) > 2.5 and _largest_task(split) <= 2
        assert sorted(map(str, split.select(sorted(split.columns)).collect())) == sorted(map(str, plain.select(sorted(plain.columns)).collect()))


@pytest.mark.parametrize("job", [revenue.freight_margin_risk_items, revenue.category_margin_risk, revenue.seller_cancellation_ranking, sellers.seller_category_benchmark])
def test_split_reports_are_the_same(large, hot, job):
    t = hot[0]
    want = job(t, k=None).collect()
    assert job(with_hot_keys(t), k=None).collect() == want != []


def test_split_join_with_missing_and_repeated_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5), ("h", 6), ("h", 7)], "k string, n int")
    right = spark.createDataFrame([("a", "A", None), ("b", "B", 1), ("b", "B2", 2), ("h", None, None), (None, "N", 3)], "k string, x string, y int")
    want = sorted(map(str, left.join(right, "k").select("k", "n", "x", "y").collect()))
    for values in ((), ("h",), ("a", "h", "z"), ("b",), ("absent",)):
        assert sorted(map(str, split_join(left, right, "k", values).select("k", "n", "x", "y").collect())) == want
