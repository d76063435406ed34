"""Published marts: the eight tables written once, for many queries, in whole versions.

The reference loads its tables once and then runs every statement against
them; this is the same step, and it happens only when a caller asks for it.

Versions.  ``publish_marts`` writes a snapshot folder of its own and, last of all, one small
manifest ``_versions/vN.json`` that names the snapshot's folders.  Readers take the newest
manifest, so they see a version whole or not at all: a publish that fails in the middle leaves the
version before it, and of two publishes at once both are whole and the later one is read.
``open_marts(version=)`` reads an older one; ``vacuum_marts`` deletes what old versions alone use.
The manifest appears by a rename, which a file system such as HDFS does atomically; on an
object store give it a committer or a table format that does the same.

Layout of a version:

* ``buckets``: ``orders``, ``order_items``, ``reviews`` and ``payments``, all joined on
  ``order_id``, are bucketed on it, so that joins and per-order aggregates between them need no
  shuffle.  A bucket is read by one task and a shuffle-free join cannot be split by AQE, so the
  choice is the caller's: ``suggested_buckets`` gives a count for a table size, and
  ``bucket_skews`` measures how even the buckets would be.
* ``by_month``: orders are partitioned by month of purchase.  ``open_marts(months=)`` reads
  only those partitions, and ``publish_months`` writes only the months it is given: the new version
  takes all other months, and all other tables, from the version before it.
* Otherwise files of about ``FILE_BYTES``, and at least one for each core.  Rows are sorted
  within files by the columns that statements filter on, so that the statistics of row groups and pages leave out
  the rest, and the order-keyed tables carry Bloom filters on ``order_id``.

The manifest also has the values that hold a large share of the items (``common.hot_keys``), so
that joins on them are split without another scan.  Bucketed reads need the tables in the session's catalog;
``drop_marts`` takes them out of it again (the files stay).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.common import hot_keys
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources.schemas import SCHEMAS
from marketlens.sources.tables import Tables

ORDER_KEYED = ("orders", "order_items", "reviews", "payments")
#: Columns that statements filter on: files are sorted by them.
CLUSTERED = {
    "orders": ("order_status", "order_purchase_timestamp"),
    "order_items": ("price",),
    "payments": ("payment_type", "payment_installments"),
}
MONTH = "purchase_month"
MAX_RECORDS_PER_FILE = 5_000_000
FILE_BYTES = 128 << 20


def _table_name(path: str, table: str) -> str:
    return f"marketlens_{hashlib.sha1(path.encode()).hexdigest()[:10]}_{table}"


# ---------------------------------------------------------------- bucket sizes

def bucket_skew(df: DataFrame, buckets: int, key: str = "order_id") -> float:
    """Largest bucket's rows over the mean bucket's rows (1.0 = perfectly even)."""
    return bucket_skews({"t": df}, buckets, key)["t"]


def bucket_skews(frames: dict[str, DataFrame], buckets: int, key: str = "order_id") -> dict[str, float]:
    """Per table: largest bucket's rows over the mean bucket's rows.

    One job: the key columns of all tables are tagged and unioned, counted
    per (table, bucket) with a partial aggregate; only at most
    ``len(frames) × buckets`` counts reach the driver.
    """
    keys = [df.select(F.lit(name).alias("tbl"), F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")) for name, df in frames.items()]
    sizes = reduce(DataFrame.unionByName, keys).groupBy("tbl", "bucket").count()
    summary = sizes.groupBy("tbl").agg(F.max("count").alias("top"), F.sum("count").alias("total")).collect()
    out = {name: 1.0 for name in frames}
    for row in summary:
        if row["total"]:
            out[row["tbl"]] = row["top"] * buckets / row["total"]
    return out


TARGET_BUCKET_BYTES = 256 * 1024 * 1024


def suggested_buckets(items_bytes: int, cores: int) -> int:
    """One bucket per 256 MB of line items, and at least one per core: a bucket's
    size does not grow with the table."""
    return max(cores, -(-items_bytes // TARGET_BUCKET_BYTES))


# ---------------------------------------------------------------- manifests

def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions under ``root``, oldest first."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version consists of; the newest one if none is named."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no published version {version or ''} under {root}")
    fs, path = _fs(spark, f"{root.rstrip('/')}/_versions/v{version or found[-1]:010d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, body: dict) -> int:
    """Make ``body`` the newest version: one file appears by a rename, under a number not yet taken."""
    fs, draft = _fs(spark, f"{root}/_versions/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    while True:
        number = (versions(spark, root) or [0])[-1] + 1
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(body | {"version": number}, indent=1).encode()))
        stream.close()
        _, target = _fs(spark, f"{root}/_versions/v{number:010d}.json")
        if not fs.exists(target) and fs.rename(draft, target):
            return number


# ---------------------------------------------------------------- writing

def _files(df: DataFrame) -> int:
    """Files of about FILE_BYTES by the optimizer's estimate (none: an exabyte or more), and at least one for each core."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-estimate // FILE_BYTES) if estimate < 1 << 60 else 0)


def _with_month(orders: DataFrame) -> DataFrame:
    return orders.withColumn(MONTH, F.date_format("order_purchase_timestamp", "yyyy-MM"))


def _write(df: DataFrame, name: str, path: str, buckets: int | None, by_month: bool) -> dict:
    """Write one table; what the manifest says about it."""
    order = [c for c in CLUSTERED.get(name, ()) if c in df.columns]
    if name in ORDER_KEYED and buckets:
        # Hash partitioning on order_id with the bucket count puts each
        # bucket in one task, so each bucket is one file (not one per task).
        writer = df.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").option("path", path)
        writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).saveAsTable(_table_name(path, name))
        return {"path": path, "buckets": buckets}
    if name == "orders" and by_month:
        # Rebalancing keeps a month together, but splits a large one into files of the advisory size.
        dated = _with_month(df).hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, *order)
        _options(dated.write, name).partitionBy(MONTH).parquet(path)
        months = [r[MONTH] for r in df.sparkSession.read.parquet(path).select(MONTH).distinct().collect()]
        return {"months": {m or "": f"{path}/{MONTH}={m or '__HIVE_DEFAULT_PARTITION__'}" for m in months}}
    even = df.repartition(_files(df))
    _options((even.sortWithinPartitions(*order) if order else even).write, name).parquet(path)
    return {"path": path}


def _options(writer, name: str):
    writer = writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    return writer.option("parquet.bloom.filter.enabled#order_id", "true") if name in ORDER_KEYED else writer


def publish_marts(t: Tables, root: str, buckets: int | None = None, by_month: bool = False) -> Tables:
    """Write every table as a new version under ``root`` and return Tables reading it.

    ``buckets``: number of ``order_id`` buckets of the order-keyed tables; ``by_month``: orders
    partitioned by month of purchase instead.  A failing write raises, and the version before stays the newest.
    """
    if buckets and by_month:
        raise ValueError("orders are either bucketed or partitioned by month")
    spark = t.spark
    root = root.rstrip("/")
    snapshot = f"{root}/data/{uuid.uuid4().hex}"
    # The writes are independent Spark jobs; submitting them together
    # lets the scheduler fill the cluster instead of running them one by one.
    with ThreadPoolExecutor(max_workers=4) as pool:
        hot = pool.submit(hot_keys, t)
        parts = {name: pool.submit(_write, df, name, f"{snapshot}/{name}", buckets, by_month) for name, df in t.as_dict().items()}
        tables = {name: part.result() for name, part in parts.items()}
        body = {"created": dt.datetime.now(dt.timezone.utc).isoformat(), "tables": tables, "hot": hot.result()}
    return open_marts(spark, root, version=_commit(spark, root, body))


def publish_months(orders: DataFrame, root: str) -> Tables:
    """A new version in which the months of ``orders`` are replaced by its rows.

    Only these months are written; all other months and tables are those of the newest version.
    """
    spark = orders.sparkSession
    root = root.rstrip("/")
    before = manifest(spark, root)
    if "months" not in before["tables"]["orders"]:
        raise ValueError(f"orders under {root} are not partitioned by month")
    written = _write(orders, "orders", f"{root}/data/{uuid.uuid4().hex}/orders", None, True)
    months = before["tables"]["orders"]["months"] | written["months"]
    body = before | {"created": dt.datetime.now(dt.timezone.utc).isoformat(), "tables": before["tables"] | {"orders": {"months": months}}}
    return open_marts(spark, root, version=_commit(spark, root, body))


# ---------------------------------------------------------------- reading

def open_marts(spark: SparkSession, root: str, version: int | None = None, months: tuple[str, str] | None = None) -> Tables:
    """Tables over a published version (the newest if none is named); registers bucketed tables if
    this session's catalog does not know them yet.  ``months``: only orders of the months from the first
    to the last ('yyyy-MM'); their partitions alone are listed and read."""
    root = root.rstrip("/")
    body = manifest(spark, root, version)
    frames: dict[str, DataFrame] = {}
    for name, schema in SCHEMAS.items():
        found = body["tables"][name]
        if "months" in found:
            paths = [p for m, p in sorted(found["months"].items()) if months is None or months[0] <= m <= months[1]]
            frames[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
            continue
        path = found["path"]
        if found.get("buckets"):
            table = _table_name(path, name)
            if not spark.catalog.tableExists(table):
                cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
                spark.sql(
                    f"CREATE TABLE {table} ({cols}) USING parquet "
                    f"CLUSTERED BY (order_id) INTO {found['buckets']} BUCKETS LOCATION '{path}'"
                )
            frames[name] = spark.table(table).select([f.name for f in schema])
        else:
            frames[name] = spark.read.schema(schema).parquet(path)
        if months is not None and name == "orders":
            frames[name] = frames[name].where(F.date_format("order_purchase_timestamp", "yyyy-MM").between(*months))
    return Tables(**frames, hot=body["hot"])


def footer_row_counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row, one column per table: row counts from the Parquet footers alone.

    The DataSource V2 reader pushes COUNT(*) down to the footers, so no data page is read.  The two
    settings it needs hold only while the counts are planned and run; eight numbers reach the driver."""
    body = manifest(spark, root, version)
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        counts = {}
        for name, found in body["tables"].items():
            paths = list(found["months"].values()) if "months" in found else [found["path"]]
            counts[name] = footer_count(spark, name, paths).first()[0] if paths else 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return spark.createDataFrame([tuple(counts[n] for n in SCHEMAS)], ", ".join(f"{n} long" for n in SCHEMAS))


def footer_count(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(*paths).agg(F.count(F.lit(1)).alias("rows"))


def drop_marts(spark: SparkSession, root: str) -> None:
    """Take the bucketed tables of all versions of ``root`` out of the session's catalog; their files stay."""
    for version in versions(spark, root):
        for name, found in manifest(spark, root, version)["tables"].items():
            if found.get("buckets"):
                spark.sql(f"DROP TABLE IF EXISTS {_table_name(found['path'], name)}")


def vacuum_marts(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Forget all but the newest ``keep`` versions and delete the folders that no kept version
    names (those of failed publishes, too: run it while nobody publishes).  Returns what it deleted."""
    if keep < 1:
        raise ValueError("the newest version stays")
    root = root.rstrip("/")
    numbers = versions(spark, root)
    used = set()
    for version in numbers[-keep:]:
        for found in manifest(spark, root, version)["tables"].values():
            used |= set(found["months"].values()) if "months" in found else {found["path"]}
    fs, data = _fs(spark, f"{root}/data")
    for version in numbers[:-keep]:
        fs.delete(_fs(spark, f"{root}/_versions/v{version:010d}.json")[1], False)
    gone = []
    for snapshot in fs.listStatus(data) if fs.exists(data) else []:
        for table in fs.listStatus(snapshot.getPath()):
            path = f"{root}/data/{snapshot.getPath().getName()}/{table.getPath().getName()}"
            live = {p for p in used if p == path or p.startswith(path + "/")}
            # a folder of which no kept version names anything, else the months that none names
            stale = [path] if not live else [f"{path}/{m.getPath().getName()}" for m in fs.listStatus(table.getPath()) if m.isDirectory() and path not in live]
            for p in stale:
                if p not in live:
                    fs.delete(_fs(spark, p)[1], True)
                    gone.append(p)
    return gone


def marts_root(spark: SparkSession) -> str:
    """A fresh folder for one publication inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/marts/{uuid.uuid4().hex}"
