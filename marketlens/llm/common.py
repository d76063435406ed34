"""Helpers shared by the corpus operators: tables, shared scratch, row keys, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the vectorised code in slices of about this many bytes;
#: a longer text makes a slice of its own.
SLICE_BYTES = 1 << 19


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster:
    from the same path, or from what was given with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


#: Rows handed to Python at a time: texts are long, so that fewer than Spark's default keep memory low.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS, unless the session has a smaller size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without one, a temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="marketlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor re-reads a file instead of
    recomputing the steps before it, and several readers compute them once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _h): the two columns the operators read and a hash that tells
    apart different texts under one doc_id.  Other columns are not looked at, so
    they may have any name."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, each made from one of ``names``."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def same_row(docs: DataFrame, doc_id: str, h: str):
    """Join condition: a row of ``docs`` and a result's (doc_id, text hash) columns."""
    return docs["doc_id"].cast("long").eqNullSafe(F.col(doc_id)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(h))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds more than ``limit`` bytes of text, unless one text does."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fold a document belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a result of bounded size as arrays on the driver, by Arrow and not row by row."""
    got = df.toArrow()
    return {name: got.column(name).to_numpy() for name in got.column_names}


#: Bits of a key bitmap: 8 MB whatever the number of keys.
BITMAP_BITS = 26


class KeyBitmap:
    """A one-hash Bloom filter of 64-bit keys with a fixed size.

    A "no" is certain.  Wrongly passed keys are few while there are fewer keys than bits
    and become more beyond that; they cost rows in a later exact join, never a result.
    """

    def __init__(self, keys: DataFrame, column: str):
        slot = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b"))
        found = columns(words)
        self.words = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
        self.words[found["w"]] = found["b"].view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & np.uint64((1 << BITMAP_BITS) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
