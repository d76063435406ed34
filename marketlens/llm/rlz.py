"""Operator 5: substring dedup by relative Lempel-Ziv parsing.

A document is parsed into factors that occur in earlier documents (smaller doc_id); factors
of ``WINDOW`` words or more are duplicate spans.  The reference is every earlier document,
cut into blocks and indexed by block key (``windows.window_blocks``):

1. Phrases.  A phrase is a run of blocks from one block whose hash is divisible by
   ``PHRASE`` to the next.  Per phrase: its earliest place and the last document that has it.
   A later document's equal phrase is a factor as it stands, for all its blocks at once.
2. Index.  The same per (key, block hash), for the blocks of the phrases left over.
3. Factor boundaries.  Where a factor begins or ends inside a block, equal windows sit in
   *different* blocks with one key.  For keys with several blocks, each block's windows
   are looked up one by one in the index of window hashes (``boundary``).
4. Parse.  Per document the places found are joined greedily, left to right, into the
   longest factors (source document and position move along together); the words under
   factors are removed.

Scale: texts are never compared in pairs.  What moves is one row per phrase and per block (about one per
20 words), then rows of candidate phrases only, which fixed-size key bitmaps (8 MB each)
pick out during the second scan; a false candidate is dropped by the exact join.  Equal
blocks and windows are combined map-side to their minimum, so a passage in a third of all
documents is one row per task and its copies meet the minimum in a join that AQE can split.
Only texts with something to remove are shuffled (third bitmap).  Intermediate tables are
written to the shared folder.

Keys and hashes together are 128 bits, so that equal numbers mean equal words for any
realistic corpus; inside one document nothing is compared.

Defined results: null or empty text has no words; a null doc_id is neither a source nor
cut; rows with one doc_id do not cut each other; repeated rows get equal results; texts
shorter than the window are kept whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import KeyBitmap, free_names, materialize, same_row, slices, text_rows
from marketlens.llm.textvec import PLAIN, Runs, U, Words, run_hash, signed
from marketlens.llm.windows import window_blocks

WINDOW, GRAM = 50, 12
#: One block in so many begins a phrase.
PHRASE = 4


class Phrases:
    """Blocks of a slice, and the phrase that each is in."""

    def __init__(self, words: Words, width: int, k: int):
        self.hashes = Runs(words.hash)
        b = window_blocks(self.hashes, words.first, width, k)
        # text with a period repeats one block: it is kept once, with the number of its times
        other = np.ones(len(b["row"]), bool)
        other[1:] = np.logical_or.reduce([b[c][1:] != b[c][:-1] for c in ("row", "key", "hash")])
        first = np.flatnonzero(other)
        times = np.diff(np.append(first, len(other)))
        self.block = b = {c: v[first] for c, v in b.items()} | {"times": times}
        new = b["hash"] % U(PHRASE) == 0
        new[:1] = True
        new[1:] |= b["row"][1:] != b["row"][:-1]
        self.head = np.flatnonzero(new)  # first block of each phrase
        self.end = np.append(self.head[1:], len(new)) if len(new) else self.head
        self.hash = run_hash((b["hash"] ^ b["key"]) + times.astype(U) * U(0x9FB21C651E98DF25), self.head, self.end)
        self.n = np.add.reduceat(b["n"] * times, self.head) if len(new) else b["n"]


def indexed(docs: DataFrame, width: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(doc_id, start, key, hash) of every block and, with null key, every phrase of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Phrases(Words(part.column("text"), PLAIN), width, k)
                b, h = p.block, p.head
                row = np.concatenate((b["row"], b["row"][h]))
                key = np.concatenate((b["key"], np.zeros(len(h), U)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(np.concatenate((b["start"], b["start"][h])).astype(np.int32)),
                        pa.array(signed(key), mask=np.arange(len(key)) >= len(b["row"])),
                        pa.array(signed(np.concatenate((b["hash"], p.hash)))),
                    ],
                    ["doc_id", "start", "key", "hash"],
                )

    return text_rows(docs).where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, start int, key long, hash long")


BLOCKS = "array<struct<start:int,n:int,times:int,key:long,hash:long,windows:array<long>>>"


def candidates(docs: DataFrame, phrases: KeyBitmap, repeated: KeyBitmap, shared: KeyBitmap, width: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Phrases that may be repeated, or that have blocks that may be repeated or share
    their key with another block; ``blocks`` has those, the latter with the hash of every window."""
    sent = docs.sparkSession.sparkContext.broadcast((phrases, repeated, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, repeated, shared = sent.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), PLAIN)
                p = Phrases(words, width, k)
                b = p.block
                open_ = shared.has(b["key"])
                some = open_ | repeated.has(b["key"] ^ b["hash"])
                total = np.concatenate(([0], np.cumsum(some)))
                count = total[p.end] - total[p.head]
                again = phrases.has(p.hash)
                keep = np.flatnonzero((count > 0) | again)
                # a phrase's blocks go on if one of them does; a kept phrase without any has an empty list
                pick = np.flatnonzero(some)
                open_ = open_[pick]
                start, n, row = b["start"][pick], b["n"][pick], b["row"][pick]
                g = signed(p.hashes.grams(width))
                size = np.where(open_, n, 0)
                ends = np.cumsum(size)
                at = np.repeat(words.first[row] + start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(g[at]), mask=pa.array(~open_))
                block = pa.StructArray.from_arrays(
                    [*(pa.array(x.astype(np.int32)) for x in (start, n, b["times"][pick])), pa.array(signed(b["key"][pick])), pa.array(signed(b["hash"][pick])), windows],
                    ["start", "n", "times", "key", "hash", "windows"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[keep]))).astype(np.int32)), block)
                head = p.head[keep]
                take = pa.array(b["row"][head])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(take),
                        part.column("_h").take(take),
                        pa.array(b["start"][head].astype(np.int32)),
                        pa.array(p.n[keep].astype(np.int32)),
                        pa.array(signed(p.hash[keep])),
                        pa.array(again[keep]),
                        lists,
                    ],
                    ["doc_id", "_h", "start", "n", "phrase", "again", "blocks"],
                )

    rows = text_rows(docs).where("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id long, _h long, start int, n int, phrase long, again boolean, blocks {BLOCKS}")


def earlier_places(docs: DataFrame, width: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(doc_id, _h, start, n, times, step, ref): n windows from word ``start`` on that also occur in
    an earlier document, at ref = (doc_id, start); the same again ``step`` words on, ``times`` in all."""
    index = indexed(docs, width, k).groupBy("key", "hash").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.max("doc_id").alias("last"))
    index = materialize(index, "rlz-index")
    again = index.where("ref.doc_id < last")
    phrases = again.where("key is null").select(F.col("hash").alias("phrase"), "ref")
    whole = again.where("key is not null").select("key", "hash", "ref")
    several = index.where("key is not null").groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("ref.doc_id").alias("lo"), F.max("last").alias("hi"))
    several = materialize(several.where("a <> b and lo < hi").select("key"), "rlz-keys")
    repeated = KeyBitmap(whole.select(F.col("key").bitwiseXOR(F.col("hash")).alias("x")), "x")
    near = candidates(docs, KeyBitmap(phrases, "phrase"), repeated, KeyBitmap(several, "key"), width, k)
    near = materialize(near, "rlz-candidates")
    place = ["doc_id", "_h", "start", "n", "times", "step", "ref"]
    found = materialize(near.where("again").join(phrases, "phrase", "left"), "rlz-phrases")
    long_factors = found.where("ref.doc_id < doc_id").withColumns({"times": F.lit(1), "step": F.lit(0)}).select(place)
    # a document with a phrase's earliest place goes on with its blocks; the others have them there already
    rest = found.where("ref is null or ref.doc_id >= doc_id").select("doc_id", "_h", "blocks").union(near.where("not again").select("doc_id", "_h", "blocks"))
    near = materialize(rest.select("doc_id", "_h", F.explode("blocks").alias("b")).select("doc_id", "_h", "b.*"), "rlz-blocks")
    factors = near.select("doc_id", "_h", "start", "n", "times", F.col("n").alias("step"), "key", "hash")
    factors = factors.join(whole, ["key", "hash"]).where("ref.doc_id < doc_id").select(place)
    factors = long_factors.unionByName(factors)

    open_blocks = near.where("windows is not null").join(several, "key").join(whole, ["key", "hash"], "left")
    open_blocks = materialize(open_blocks.where("ref is null or ref.doc_id >= doc_id").select("doc_id", "_h", "start", "times", F.col("n").alias("step"), "key", "windows"), "rlz-boundary")
    each = open_blocks.select("doc_id", "_h", "start", "times", "step", "key", F.posexplode("windows").alias("i", "window"))
    each = each.select("doc_id", "_h", (F.col("start") + F.col("i")).alias("start"), "times", "step", "key", "window")
    first = each.groupBy("key", "window").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.max("doc_id").alias("last")).where("ref.doc_id < last")
    boundary = each.join(first.select("key", "window", "ref"), ["key", "window"]).where("ref.doc_id < doc_id")
    return factors.unionByName(boundary.withColumn("n", F.lit(1)).select(place))


def parse(places: list[dict], width: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length in words, ref doc, ref start), left to right.

    From the leftmost place not yet covered on, a factor follows one source for as long
    as the places go on with it; the next factor may begin at any place after that."""
    out: list[tuple[int, int, int, int]] = []
    each = [(p["start"] + i * p["step"], p["n"], p["ref"]["doc_id"], p["ref"]["start"]) for p in places for i in range(p["times"])]
    for start, n, doc, ref in sorted(each, key=lambda p: (p[0], -p[1])):
        if out:
            a, length, d, r = out[-1]
            if d == doc and ref - r == start - a and start <= a + length - width + 1:
                out[-1] = (a, max(length, start - a + n - 1 + width), d, r)
                continue
        out.append((start, n - 1 + width, doc, ref))
    return out


def covered(factors: list[tuple[int, int, int, int]], n_words: int) -> np.ndarray:
    mark = np.zeros(n_words + 1, np.int64)
    for start, length, *_ in factors:
        mark[start] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:-1]) > 0


SCHEMA = (
    "doc_id long, _h long, n_words long, n_removed long, kept_sha256 string, cleaned string,"
    " factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"
)


def deduplicate(docs: DataFrame, width: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Per document row: n_words, n_removed, kept_sha256 (kept words joined by one space),
    ``cleaned`` (the text without the removed words, null if nothing is removed) and ``factors``."""
    found = earlier_places(docs, width, k).groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "n", "times", "step", "ref")).alias("places"))
    found = materialize(found, "rlz-places")
    cut = KeyBitmap(found.select(F.xxhash64("doc_id", "_h").alias("x")), "x")
    sent = docs.sparkSession.sparkContext.broadcast(cut)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of texts without places; the others' texts go on."""
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), PLAIN)
                go_on = sent.value.has(part.column("x").to_numpy(zero_copy_only=False).view(np.uint64))
                texts = part.column("text").to_pylist()
                sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("_h"),
                        pa.array([t if g else None for t, g in zip(texts, go_on)], pa.string()),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.array(sha),
                    ],
                    ["doc_id", "_h", "text", "n_words", "kept_sha256"],
                )

    def cut_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = part.select(["doc_id", "_h", "n_words", "kept_sha256", "places"]).to_pylist()
                words = Words(part.column("text"), PLAIN)
                for i, row in enumerate(rows):
                    factors = parse(row.pop("places") or [], width)
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = covered(factors, b - a)
                    row |= {"n_removed": int(gone.sum()), "cleaned": None}
                    row["factors"] = [dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in factors]
                    if factors:
                        kept = np.flatnonzero(~gone)
                        row["kept_sha256"] = hashlib.sha256(b" ".join(words.bytes_of(a + j) for j in kept.tolist())).hexdigest()
                        row["cleaned"] = without_words(words, i, gone)
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    rows = text_rows(docs).withColumn("x", F.xxhash64("doc_id", "_h")).mapInArrow(untouched, "doc_id long, _h long, text string, n_words long, kept_sha256 string")
    rest = found.select(F.col("doc_id").alias("__id"), F.col("_h").alias("__h"), "places")
    none = F.array().cast("array<struct<start:int,length:int,ref_doc:long,ref_start:int>>")
    same = rows.where("text is null").select("doc_id", "_h", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("cleaned"), none.alias("factors"))
    touched = rows.where("text is not null").join(rest, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("_h").eqNullSafe(F.col("__h")), "left").drop("__id", "__h")
    return same.unionByName(touched.mapInArrow(cut_places, SCHEMA))


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("_h", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("cleaned", pa.string()),
        ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))),
    ]
)


def without_words(words: Words, row: int, gone: np.ndarray) -> str:
    """The row's text without the marked words and the white space after each."""
    first, at, end = int(words.first[row]), int(words.offsets[row]), int(words.offsets[row + 1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(words.raw[at : words.start[first + a]].tobytes())
        at = int(words.start[first + b]) if b < len(gone) else end
    out.append(words.raw[at:end].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate spans cut out of its texts, same columns and rows."""
    found = deduplicate(docs).where("n_removed > 0")
    id_, h, cleaned = free_names(docs, "cut_id", "cut_hash", "cut_text")
    found = found.groupBy(F.col("doc_id").alias(id_), F.col("_h").alias(h)).agg(F.first("cleaned").alias(cleaned))
    joined = docs.join(found, same_row(docs, id_, h), "left")
    text = F.coalesce(F.col(cleaned), docs["text"])
    columns = [text.alias(c) if c == "text" else F.when(F.col(cleaned).isNotNull(), F.length(text)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and the number of factors."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").cast("long").alias("n_factors"))
