"""Operator 13: hard negatives from exact integer scores, by subset-sum tables (Four Russians).

Vectors are scaled and rounded down to integers.  For an anchor, each group of eight
dimensions has a table of its 256 subset sums.  A candidate's components, in two's
complement, are packed by bit plane: one byte for each plane and group, which is the index
into the group's table.  The sum of the looked-up values of a plane, shifted by the plane's
place (the sign plane counts negative), adds up to the full exact inner product.

1. Anchors and candidates are dealt to blocks by a hash of the row (``ANCHORS`` and ``ROWS``
   of them); every pair of blocks is a cell, one group of a cogroup.  A cell scores its
   anchors against its candidates and keeps, for each anchor, its best rows of the same label.
2. The best of all cells are the anchor's positives.  Every cell then scores again, with the
   anchors' positive scores beside them, and keeps for each positive the first rows of other
   labels within its band; the first of all cells are the result.

Scale: the anchors are a stated query set against all rows, in blocks of bounded size; a
cell's work is in proportion to its two blocks, whatever the labels are, so a label or a
vector that a third of all rows have makes no cell larger.  What leaves a cell is bounded by
its anchors (``positives``, and ``positives`` times ``negatives`` rows each).  The driver sees the
numbers of rows and anchors.

Defined results: rows with a null label, id or vector, or with a null or non-finite component, take
no part; repeated rows (same id, label and vector) are one row; an anchor's positives have
other ids than the anchor; different rows under one id are rows of their own; equal scores are ordered by id;
shorter vectors end in zeros; scores beyond 64 bits stay at the largest or smallest; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm.common import materialize

#: Candidates and anchors of a cell.
ROWS, ANCHORS = 8192, 512
#: Anchors and candidates scored at a time, so that tables and sums stay in the cache.
_TABLES, _CHUNK = 64, 2048
_TOP = (1 << 63) - 1


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector as a row; 64-bit if that holds them, else Python integers."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = -(-int(sizes.max(initial=0)) // 8) * 8
    x = np.zeros((len(vectors), wide))
    x[np.arange(wide) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0) < 1 << 53:
        return y.astype(np.int64)
    exact = [math.floor(b) if math.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist())]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def bit_planes(v: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bytes of eight components' bits, the last plane is the sign."""
    bits = 1 + max(int(v.max(initial=0)).bit_length(), (-1 - int(v.min(initial=0))).bit_length())
    planes = []
    for p in range(bits):
        bit = ((v >> p) & 1).astype(np.uint8)
        planes.append(np.packbits(bit, axis=1, bitorder="little").T)
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of each eight components."""
    n, wide = anchors.shape
    tables = np.zeros((wide // 8, 256, n), anchors.dtype)
    grouped = anchors.T.reshape(wide // 8, 8, n)
    for k in range(8):
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + grouped[:, k : k + 1]
    return tables


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products (anchors, candidates), exact; beyond 64 bits the largest or smallest."""
    wide = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (anchors, candidates))
    out = np.zeros((len(anchors), len(candidates)), np.int64)
    if not wide or not out.size:
        return out
    planes = bit_planes(candidates)
    reach = (1 << len(planes)) * wide * max(int(anchors.max()), -int(anchors.min()))
    kind = np.int32 if reach < 1 << 31 else np.int64 if reach < 1 << 63 else object
    for a in range(0, len(anchors), _TABLES):
        tables = subset_sums(anchors[a : a + _TABLES].astype(kind))
        for c in range(0, len(candidates), _CHUNK):
            index = planes[:, :, c : c + _CHUNK]
            total = np.zeros((index.shape[2], tables.shape[2]), kind)
            looked = np.empty_like(total)
            for p in range(len(planes)):
                part = tables[0].take(index[p, 0], axis=0)
                for g in range(1, len(tables)):
                    tables[g].take(index[p, g], axis=0, out=looked, mode="clip")
                    part += looked
                part *= kind(1 << p) if kind is not object else 1 << p
                if p == len(planes) - 1:
                    total -= part
                else:
                    total += part
            if kind is object:
                total = np.clip(total, -_TOP, _TOP)
            out[a : a + _TABLES, c : c + _CHUNK] = total.T
    return out


def usable(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(x, vec_id, label, embedding, anchor): distinct rows that take part; x tells them apart."""
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(whole, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", is_anchor.alias("anchor"))
    return rows.dropDuplicates(["vec_id", "label", "embedding"]).withColumn("x", F.xxhash64("vec_id", "label", "embedding"))


def cells(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int]):
    """Cogroup of every block of anchors with every block of candidates."""
    n_c, n_a = (max(1, -(-n // most)) for n, most in zip(sizes, (ROWS, ANCHORS)))
    c, a = F.pmod("x", F.lit(n_c)).alias("c"), F.pmod("x", F.lit(n_a)).alias("a")
    left = anchors.select("*", a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("c"))
    renamed = rows.select("x", "vec_id", "label", "embedding").toDF("x", "vec_id", "label", "embedding")
    right = renamed.select("*", c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_a - 1).cast("long"))).alias("a"))
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c"))


def _scored(left: pa.Table, right: pa.Table, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of a cell: its place, its scores and the labels; candidates by id."""
    label = right.column("label").to_numpy()
    vectors = integers(right.column("embedding"), scale)
    mine = integers(left.column("embedding"), scale)
    if mine.dtype != vectors.dtype:
        mine, vectors = mine.astype(object), vectors.astype(object)
    for at in range(0, len(mine), _TABLES):
        for i, s in enumerate(scores(mine[at : at + _TABLES], vectors)):
            yield at + i, s, label


def positives(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], n: int, scale: int) -> DataFrame:
    """(x, found): each anchor's best rows of its label, as (score, id), best first."""
    schema = "x long, positive_id long, positive_score long, other long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("vec_id", "ascending"), ("x", "ascending")]) if len(right) else right
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            ids, xs = right.column("vec_id").to_numpy(), right.column("x").to_numpy()
            own, own_x, own_label = (left.column(k).to_numpy() for k in ("vec_id", "x", "label"))
            for i, s, label in _scored(left, right, scale):
                fit = np.flatnonzero((label == own_label[i]) & (ids != own[i]))
                best = fit[np.argsort(-s[fit], kind="stable")[:n]]
                for column, values in zip(out, (np.full(len(best), own_x[i]), ids[best], s[best], xs[best])):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], ["x", "positive_id", "positive_score", "other"])

    found = cells(rows, anchors, sizes).applyInArrow(run, schema)
    order = Window.partitionBy("x").orderBy(F.desc("positive_score"), "positive_id", "other")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return best.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("found"))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors``
    (vec_id, label, embedding): negatives score ``low`` to ``high`` percent of the positive's score."""
    rows = materialize(usable(vectors, is_anchor), "negatives-rows")
    anchors = rows.where("anchor").select("x", "vec_id", "label", "embedding")
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    best = materialize(positives(rows, anchors, tuple(sizes), n_positives, scale), "negatives-positives")
    schema = "x long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, other long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("vec_id", "ascending"), ("x", "ascending")]) if len(right) else right
        out: list[list] = [[] for _ in range(8)]
        if len(left) and len(right):
            ids, xs = right.column("vec_id").to_numpy(), right.column("x").to_numpy()
            own, own_x, own_label = (left.column(k).to_numpy() for k in ("vec_id", "x", "label"))
            pairs = left.column("found").to_pylist()
            for i, s, label in _scored(left, right, scale):
                fit = np.flatnonzero(label != own_label[i])
                fit = fit[np.argsort(-s[fit], kind="stable")]
                falling = -s[fit]
                for pair in pairs[i]:
                    p = pair["positive_score"]
                    start = np.searchsorted(falling, -(high * p // 100), "left")
                    end = min(start + n_negatives, np.searchsorted(falling, -low * p // 100, "right"))
                    got = fit[start:end]
                    same = (own_x[i], pair["nth"], own[i], pair["positive_id"], p)
                    for column, values in zip(out, (*(np.full(len(got), v, np.int64) for v in same), ids[got], s[got], xs[got])):
                        column.append(values)
        arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        arrays[1] = arrays[1].cast(pa.int32())
        return pa.table(arrays, ["x", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "other"])

    found = cells(rows, anchors.join(best, "x"), tuple(sizes)).applyInArrow(run, schema)
    order = Window.partitionBy("x", "nth").orderBy(F.desc("negative_score"), "negative_id", "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, the label is the next one of ten."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def report(vectors: DataFrame) -> DataFrame:
    """The registered query: anchors are the rows whose vec_id is divisible by 100."""
    return mine(relabelled(vectors), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
with usable as (
  select distinct vec_id, label, embedding from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from usable
), parts as (
  select vec_id, label, unnest(e) as value, unnest(range(len(e))) as place from vectors
), scored as (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, sum(a.value * c.value) as score
  from parts a join parts c on a.place = c.place where a.vec_id % 100 = 0
  group by a.vec_id, a.label, c.vec_id, c.label
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored
  where same and other_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), negatives as (
  select p.anchor_id, p.positive_id, s.other_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
   and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id,
       cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score
from negatives where rank <= 10
"""
