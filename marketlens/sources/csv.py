"""Typed CSV ingest of the eight marketplace exports.

* Columns bind by position to the declared schema (header line skipped,
  never inferred).
* Fields are ``,``-separated and ``"``-quoted; a doubled quote inside quotes
  is a literal quote.  Only ``reviews`` carries free text that may span
  lines.  Spark's ``multiLine`` reads such a file in one task; here its records are put
  together from lines that are read in splits (``quoted_records``), so every table is splittable.
  ``whole_files=True`` takes the one-task reader, which also bears stray quotes within unquoted fields.
* ``lenient`` (PERMISSIVE) keeps malformed rows as NULLs and records the raw
  line in ``_corrupt_record``; ``strict`` (FAILFAST) stops at the first one.
  Blank fields become NULL in both modes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.sources.schemas import SCHEMAS
from marketlens.sources.tables import Tables

CORRUPT = "_corrupt_record"
MULTILINE_TABLES = {"reviews"}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order -> records (file, at, nth, record, begun, open): the nth of the split at byte
    ``at``; ``begun``: it begins in this split, ``open``: it goes on in the next one."""
    place, odd, nth, held = None, 0, 0, []
    out: list[tuple] = []

    def end(is_open: bool) -> None:
        if held:
            out.append((*place, nth, "\n".join(held), not (nth == 0), is_open))
            held.clear()

    for batch in batches:
        files, starts, inside, lines = (batch.column(i).to_pylist() for i in range(4))
        quotes = pa.compute.count_substring(batch.column(3), '"').to_pylist()
        for file, at, state, line, n in zip(files, starts, inside, lines, quotes):
            if (file, at) != place:
                end(bool(odd))
                place, odd, nth = (file, at), state, 0  # the 0th is the rest of a record begun before
            if not odd:
                end(False)
                nth += 1
            held.append(line)
            odd ^= n & 1
        if len(out) >= 10_000:
            yield _records(out)
            out = []
    end(bool(odd))
    if out:
        yield _records(out)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "at", "nth", "record", "begun", "open"])


def quoted_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the records of CSV files, which may span lines inside quotes, read in parallel splits.

    A split begins inside quotes if the number of quotes before it in its file is odd (a doubled quote is
    two).  One scan counts the quotes of every split, a running sum over a file's splits (one row each) gives
    each its state, and a second scan puts lines together to records.  Only the pieces of records that cross
    a split are brought together, at most two a split.
    """
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "at").agg(F.sum(quotes).alias("q"))
    before = F.coalesce(F.sum("q").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    states = splits.select("file", "at", (before % 2).cast("int").alias("inside"))
    read = lines.join(F.broadcast(states), ["file", "at"]).select("file", "at", "inside", "value")
    found = read.mapInArrow(_runs, "file string, at long, nth long, record string, begun boolean, open boolean")
    whole = found.where("begun and not open")
    pieces = found.where("open or not begun")
    # a record that crosses splits: its begin, and all pieces up to the next begin
    number = F.sum(F.col("begun").cast("int")).over(Window.partitionBy("file").orderBy("at", "nth"))
    joined = pieces.withColumn("number", number).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("at", "nth", "record"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["nth"].alias("nth"), F.concat_ws("\n", F.col("p.record")).alias("record"))
    records = whole.select("file", "at", "nth", "record").unionByName(joined)
    if header:
        records = records.where("not (at = 0 and nth = 1)")
    return records.select(F.rtrim(F.col("record"), F.lit("\r")).alias("record")).where("record <> ''")


def read_csv(spark: SparkSession, table: str, path: str, lenient: bool = True, whole_files: bool = False) -> DataFrame:
    """One table; in lenient mode the result has an extra ``_corrupt_record`` column."""
    schema = SCHEMAS[table]
    if lenient:
        schema = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    if table in MULTILINE_TABLES and not whole_files:
        options = {"sep": ",", "quote": '"', "escape": '"', "timestampNTZFormat": TIMESTAMP_FORMAT, "mode": "PERMISSIVE" if lenient else "FAILFAST"}
        if lenient:
            options["columnNameOfCorruptRecord"] = CORRUPT
        parsed = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options)
        return quoted_records(spark, path).select(parsed.alias("r")).select("r.*")
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", table in MULTILINE_TABLES)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("mode", "PERMISSIVE" if lenient else "FAILFAST")
    )
    if lenient:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path)


def load_csv(spark: SparkSession, paths: dict[str, str], lenient: bool = True) -> Tables:
    """All eight tables from their CSV paths, each with exactly its declared columns."""
    frames = {}
    for table, schema in SCHEMAS.items():
        df = read_csv(spark, table, paths[table], lenient)
        frames[table] = df.select([f.name for f in schema])
    return Tables(**frames)


def corrupt_row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per table that did not parse against the declared schema (lenient read).

    The CSV reader only parses the columns a query references, and a field
    that is not parsed cannot be found malformed; so the audit references
    every column (it also reports how many fields parsed to a non-NULL value).
    """
    frames = []
    for table, schema in SCHEMAS.items():
        df = read_csv(spark, table, paths[table], lenient=True)
        parsed = reduce(lambda a, b: a + b, [F.count(f.name) for f in schema])
        frames.append(
            df.agg(
                F.lit(table).alias("table_name"),
                F.count(F.lit(1)).alias("rows"),
                parsed.alias("non_null_fields"),
                F.count(CORRUPT).alias("corrupt_rows"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def ingest_csv(spark: SparkSession, paths: dict[str, str], out_root: str, lenient: bool = True, buckets: int | None = None) -> Tables:
    """CSV exports -> published marts (Parquet; with ``buckets`` order-keyed tables are bucketed on order_id)."""
    from marketlens.sources.marts import publish_marts

    return publish_marts(load_csv(spark, paths, lenient), out_root, buckets)
