"""Operator 8: suffix-array dedup with threshold-bounded interval expansion.

Every byte that lies under a string of ``LENGTH`` bytes which begins at another place, too
(same document included), is removed.  The order of all suffixes is never needed at once:
equal strings have the same window key (``windows.window_blocks``), so the texts are cut
into blocks (about one per 75 bytes) and brought together by key.

1. Count (key, block hash).  A block that occurs twice as it is repeats all its strings.
2. What is left open are blocks that occur once and share their key with different blocks.
   A string of LENGTH bytes reaches far to one side of the key's gram, so only blocks whose
   side piece also occurs twice stay open.  One copy of each such block is read again.
3. Per key the open blocks' Burrows-Wheeler transform is expanded backwards, breadth first
   (``bwt``), which finds the common-prefix breaks by increasing length and stops at LENGTH;
   suffixes without a break begin strings that repeat.
4. Repeated strings of a document are merged to spans and cut out.

Scale: what moves is one short row per block, then candidate rows only, picked during the
second and third scan by fixed-size key bitmaps (8 MB); false candidates fall out in exact
joins.  A task expands a bounded batch of keys at a time.  A key whose open blocks exceed
``GROUP_BYTES`` is split by the symbols that follow its gram on either side, again and again (``halves``),
until each part fits or consists of one string.  Only texts with something to cut are shuffled.

Defined results: null and empty texts have no bytes; rows are documents, so a repeated row
repeats all its strings of LENGTH bytes or more; a null doc_id is a document like others;
texts shorter than LENGTH are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bwt import repeated_windows
from marketlens.llm.common import KeyBitmap, materialize, slices, text_rows
from marketlens.llm.textvec import Runs, U, buffers, mix, signed
from marketlens.llm.windows import window_blocks

LENGTH, GRAM = 200, 48
#: One key's open blocks are expanded in one task up to this many bytes (two strings at least).
GROUP_BYTES = 1 << 20


def byte_blocks(part: pa.RecordBatch, length: int, k: int) -> tuple[np.ndarray, np.ndarray, Runs, dict]:
    raw, bounds = buffers(part.column("text"))
    runs = Runs(raw.astype(U) + U(1))
    return raw, bounds, runs, window_blocks(runs, bounds, length, k)


def row_ids(part: pa.RecordBatch, b: dict) -> np.ndarray:
    """A number for each block of each row, the same in every scan."""
    doc = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).view(U)
    h = part.column("_h").to_numpy(zero_copy_only=False).view(U)
    return mix(mix(doc[b["row"]] + h[b["row"]]) + b["start"].astype(U))


def counted_blocks(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, hash) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, _, b = byte_blocks(part, length, k)
                yield pa.RecordBatch.from_arrays([pa.array(signed(b["key"])), pa.array(signed(b["hash"]))], ["key", "hash"])

    return text_rows(docs).select("text").mapInArrow(run, "key long, hash long")


def candidates(docs: DataFrame, repeated: KeyBitmap, shared: KeyBitmap, length: int, k: int) -> DataFrame:
    """Blocks that may repeat as they are or share their key; the latter with ``rid`` and
    the hashes of the pieces beside the gram (null where the block does not reach so far)."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, shared))
    side = (length - k + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, shared = sent.value
        for batch in batches:
            for part in slices(batch):
                _, bounds, hashes, b = byte_blocks(part, length, k)
                some = shared.has(b["key"])
                pick = some | repeated.has(b["key"] ^ b["hash"])
                rid = row_ids(part, b)[pick]
                b, some = {c: v[pick] for c, v in b.items()}, some[pick]
                gram = bounds[b["row"]] + b["gram"]
                left = some & (b["gram"] - side >= b["start"])
                right = some & (b["gram"] + k + side <= b["start"] + b["n"] - 1 + length)
                pieces = []
                for mask, a in ((left, gram - side), (right, gram + k)):
                    h = np.zeros(len(gram), U)
                    h[mask] = hashes.hash(a[mask], a[mask] + side)
                    pieces.append(pa.array(signed(h), mask=~mask))
                row = pa.array(b["row"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(row),
                        part.column("_h").take(row),
                        pa.array(b["start"].astype(np.int32)),
                        pa.array(b["n"].astype(np.int32)),
                        pa.array(signed(b["key"])),
                        pa.array(signed(b["hash"])),
                        pa.array(signed(rid), mask=~some),
                        *pieces,
                    ],
                    ["doc_id", "_h", "start", "n", "key", "hash", "rid", "left", "right"],
                )

    return text_rows(docs).mapInArrow(run, "doc_id long, _h long, start int, n int, key long, hash long, rid long, left long, right long")


def block_texts(docs: DataFrame, chosen: KeyBitmap, length: int, k: int) -> DataFrame:
    """(doc_id, _h, start, gram, key, block) of the chosen block places; ``gram``: its place in the block."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, bounds, _, b = byte_blocks(part, length, k)
                pick = np.flatnonzero(sent.value.has(row_ids(part, b)))
                row, start = b["row"][pick], b["start"][pick]
                a = bounds[row] + start
                texts = [raw[i:j].tobytes() for i, j in zip(a.tolist(), (a + b["n"][pick] - 1 + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("_h").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array((b["gram"][pick] - start).astype(np.int32)), pa.array(signed(b["key"][pick])), pa.array(texts, pa.binary())],
                    ["doc_id", "_h", "start", "gram", "key", "block"],
                )

    return text_rows(docs).mapInArrow(run, "doc_id long, _h long, start int, gram int, key long, block binary")


PLACE = "doc_id long, _h long, start int, n int"


def runs(part: pa.Table | pa.RecordBatch, offsets: list[np.ndarray]) -> pa.RecordBatch:
    """Places (start, n) of consecutive offsets within each block."""
    row = np.repeat(np.arange(len(offsets)), [len(o) for o in offsets])
    off = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    new = np.ones(len(off), bool)
    new[1:] = (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)
    heads = np.flatnonzero(new)
    n = np.diff(np.append(heads, len(off)))
    take = pa.array(row[heads])
    start = part.column("start").to_numpy(zero_copy_only=False)[row[heads]] + off[heads]
    return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("_h").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "_h", "start", "n"])


def expanded(blocks: DataFrame, length: int) -> DataFrame:
    """Places of repeated strings among blocks of one key (rows come dealt and sorted by key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """Expand all held rows, but for the last key's when more may come."""
            nonlocal held, size
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column("key").to_numpy(zero_copy_only=False)
            end = len(key) if whole else int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if end:
                part = rows.slice(0, end)
                yield runs(part, repeated_windows(part.column("block").to_pylist(), length))
            held = [rows.slice(end)] if end < len(key) else []
            size = 0

        for batch in batches:
            for part in slices(batch, "block", 1 << 18):
                held.append(part)
                size += part.column("block").nbytes
                if size > GROUP_BYTES:
                    yield from flush(False)
        yield from flush(True)

    return blocks.repartition("key").sortWithinPartitions("key").mapInArrow(run, PLACE)


PART = "doc_id long, _h long, start int, gram int, key long, block binary, a int, b int"


def halves(parts: DataFrame, length: int) -> DataFrame:
    """Each part's strings in two halves by the distance between a string's begin and the gram, ``a`` to ``b``.

    Equal strings have equal distances.  All strings of a half contain the symbols from ``a`` before the
    gram to ``length - b`` after its begin, which are the half's key."""
    return parts.mapInArrow(halved(length), PART)


def halved(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "block", 1 << 19):
                out = []
                for r in part.to_pylist():
                    block, gram, middle = r["block"], r["gram"], (r["a"] + r["b"]) // 2
                    for a, b in ((r["a"], middle), (middle + 1, r["b"])):
                        first, last = max(a, gram - (len(block) - length)), min(b, gram)  # distances that the block has
                        if a <= b and first <= last:
                            inside = block[gram - a : gram - b + length]
                            salt = a.to_bytes(8, "little") + b.to_bytes(8, "little")
                            key = int.from_bytes(hashlib.blake2b(inside, digest_size=8, salt=salt).digest(), "little", signed=True)
                            out.append((r["doc_id"], r["_h"], r["start"] + gram - last, last, key, block[gram - last : gram - first + length], a, b))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), PART_TYPES)] if out else [pa.array([], k) for k in PART_TYPES], PART_NAMES)

    return run


PART_NAMES = ["doc_id", "_h", "start", "gram", "key", "block", "a", "b"]
PART_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())


def opened(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Places of repeated strings among the blocks of each key, however many blocks it has.

    A round expands the keys that fit and halves the strings of all others; after eight rounds or
    so a key that is still too large consists of one string."""
    parts = texts.withColumns({"a": F.lit(0), "b": F.lit(length - k)})
    found = []
    while True:
        large = parts.groupBy("key").agg(F.sum(F.octet_length("block")).alias("size")).where(F.col("size") > GROUP_BYTES).select("key")
        large = materialize(large, "suffix-large")
        if large.isEmpty():
            found.append(expanded(parts, length))
            break
        found.append(expanded(parts.join(large, "key", "left_anti"), length))
        rest = parts.join(large, "key", "left_semi").select(PART_NAMES)
        one = rest.where("a = b")  # equal strings; each is its whole block
        found.append(one.select("doc_id", "_h", "start", F.lit(1).alias("n")))
        parts = materialize(halves(rest.where("a < b"), length), "suffix-parts")
    return reduce(DataFrame.unionByName, found)


def repeated_places(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(doc_id, _h, start, n): n strings of ``length`` bytes from byte ``start`` on that begin elsewhere, too."""
    counts = counted_blocks(docs, length, k).groupBy("key", "hash").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "suffix-blocks")
    whole = counts.where("c > 1").select("key", "hash")
    several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("c")).where("d > 1 and c = 1").select("key")
    several = materialize(several, "suffix-keys")
    x = F.col("key").bitwiseXOR(F.col("hash")).alias("x")
    near = materialize(candidates(docs, KeyBitmap(whole.select(x), "x"), KeyBitmap(several, "key"), length, k), "suffix-candidates")
    places = near.select("doc_id", "_h", "start", "n", "key", "hash").join(whole, ["key", "hash"], "left_semi").select("doc_id", "_h", "start", "n")

    open_ = near.where("rid is not null").groupBy("key", "hash").agg(F.min(F.struct("rid", "n", "left", "right")).alias("one"))
    open_ = materialize(open_.join(several, "key", "left_semi").select("key", "one.*"), "suffix-open")
    reach = [open_.where(f"{s} is not null").groupBy("key", s).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", s) for s in ("left", "right")]
    chosen = open_.join(reach[0], ["key", "left"], "left_semi").select("key", "rid", "n").union(open_.join(reach[1], ["key", "right"], "left_semi").select("key", "rid", "n")).distinct()
    chosen = materialize(chosen, "suffix-chosen")
    texts = materialize(block_texts(docs, KeyBitmap(chosen, "rid"), length, k), "suffix-texts")
    return places.unionByName(opened(texts, length, k))


def spans(places: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges under the strings."""
    out: list[tuple[int, int]] = []
    for p in sorted(places, key=lambda p: p["start"]):
        a, b = p["start"], p["start"] + p["n"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SCHEMA = "doc_id long, _h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """Per document row: n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the remaining
    bytes; null if nothing is removed)."""
    found = repeated_places(docs, length, k).groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    found = materialize(found, "suffix-places")
    sent = docs.sparkSession.sparkContext.broadcast(KeyBitmap(found.select(F.xxhash64("doc_id", "_h").alias("x")), "x"))

    def cuttable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the texts of rows that may have places."""
        for batch in batches:
            for part in slices(batch):
                some = sent.value.has(part.column("x").to_numpy(zero_copy_only=False).view(U))
                texts = [t.encode() if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("_h"),
                        pa.array([t if s else None for t, s in zip(texts, some)], pa.binary()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ],
                    ["doc_id", "_h", "kept", "n_bytes", "kept_sha256"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "kept"):
                rows = part.to_pylist()
                for row in rows:
                    gone = spans(row.pop("places") or [], length)
                    raw, row["kept"] = row["kept"], None
                    row |= {"n_removed": sum(b - a for a, b in gone), "n_spans": len(gone)}
                    if gone:
                        edges = [0, *(e for s in gone for e in s), len(raw)]
                        row["kept"] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                        row["kept_sha256"] = hashlib.sha256(row["kept"]).hexdigest()
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    rows = text_rows(docs).withColumn("x", F.xxhash64("doc_id", "_h")).mapInArrow(cuttable, "doc_id long, _h long, kept binary, n_bytes long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    same = rows.where("kept is null").select("doc_id", "_h", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", "kept")
    rest = found.select(F.col("doc_id").alias("__id"), F.col("_h").alias("__h"), "places")
    some = rows.where("kept is not null").join(rest, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("_h").eqNullSafe(F.col("__h")), "left").drop("__id", "__h")
    return same.unionByName(some.mapInArrow(cut, SCHEMA))


OUT = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
