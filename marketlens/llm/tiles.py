"""Operator 11: n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set is its distinct word shingles, as 64-bit hashes; documents are linked if
100 * |A and B| >= 80 * |A or B|.  With ``least(n)`` the smallest overlap that a set of n shingles has
with any linked set, two linked sets share at least k of the first n - least(n) + k shingles of
either, in any order that is the same for all sets.

1. Equal sets (128 bits of two set signatures) are one class from here on.
2. In order of hash, a class has a head of n - least(n) + 1 + n/``EXTRA`` shingles.  Classes with
   fewer than about n/``EXTRA`` of them in other heads are linked with nothing and go no further.  This is a bound,
   not an estimate: no link is lost.
3. Tiles: of the other classes, the n - least(n) + 1 rarest shingles and the bands of sizes (each
   1/0.8 wide) are the keys; a class lies in the tiles of its own band and, as the smaller
   partner, of the next one, so that all linked pairs meet in a tile.
4. A tile's most central member (the fewest shingles of its own) meets all others first.  Then the
   members still in different components are dealt to cells of at most 2 * ``CELL`` members and
   compared within these; a group of copies costs a star, and no task gets a whole tile.
5. Every pair passes its sizes and places first, then bit counts: a signature has one bit for each
   hashed slot, set if an odd number of shingles fall in it, so that every bit in which two differ
   stands for a shingle that only one set has, and the overlap is at most (n + m - differing
   bits) / 2.  What that leaves is counted exactly as the intersection of the sorted arrays.
6. Links are contracted to components (``graph``).

Scale: the text is read three times (signatures, heads, sets of step 3); heads are three tenths
of all shingles, whole sets are moved for the classes of step 3 only.  No pairs leave a cell but
those that the bit counts pass.  Members of a tile that are all linked to its centre are compared once;
in an adversarial tile of very many unlinked members the cells compare all of them by
bits.  The driver sees counts and bitmaps of fixed size (``common.KeyBitmap``).

Defined results: a text of fewer words than a shingle is one shingle; null, empty or blank text
has the empty set and is linked with nothing; a null doc_id is linked with nothing and has a
null component; rows with one doc_id are one document with several sets, all linked; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import KeyBitmap, materialize, slices, text_rows
from marketlens.llm.graph import components
from marketlens.llm.minhash import lists, shingle_sets
from marketlens.llm.textvec import U, mix, signed

#: A head has n/EXTRA shingles more than one shared shingle needs.
EXTRA = 12
#: Members of a cell's two sides, and rows of a group of cells.
CELL, GROUP = 512, 50_000
#: Bits of the signatures: the power of two from the set's size on, within these.
NARROW, WIDE = 64, 4096
#: Copies of a class row that its members are dealt over.
SALT = 16


# ------------------------------------------------------------------ sets and signatures

def signatures(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set (order does not matter)."""
    with np.errstate(over="ignore"):
        both = [mix(s ^ U(seed)).sum(dtype=U) + U(len(s)) for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
        return tuple(signed(mix(np.array(both, U))).tolist())


def width(n: int) -> int:
    return min(WIDE, max(NARROW, 1 << (n - 1).bit_length()))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each slot, as 64-bit words."""
    w = width(len(s))
    odd = np.bincount((s & U(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(words: np.ndarray, n_words: int) -> np.ndarray:
    """Signatures (rows) at a smaller width: a slot of the smaller one is the parity of two."""
    while words.shape[1] > n_words:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def linked(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def overlap_bound(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most shingles that sets with these signatures (words in the last axis) can share."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (n + m - differ) // 2


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


# ------------------------------------------------------------------ rows, heads, sets

def least(n, percent: int):
    """The smallest overlap of a set of n shingles with a linked one."""
    return (n * percent + 99) // 100


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, _h, n, s, t) of every row: size and signatures of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, size)
                both = [signatures(s) for s in sets]
                columns = [[len(s) for s in sets], [s for s, _ in both], [t for _, t in both]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_h"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "_h", "n", "s", "t"])

    return text_rows(docs).mapInArrow(run, "doc_id long, _h long, n long, s long, t long")


def _chosen(docs: DataFrame, keys: DataFrame, size: int, of_set, schema: str) -> DataFrame:
    """What ``of_set(sets)`` makes of the rows whose x is among ``keys``, with (x, doc_id, n); a task gives a row once."""
    sent = docs.sparkSession.sparkContext.broadcast(KeyBitmap(keys, "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                x = part.column("x").to_numpy(zero_copy_only=False)
                keep = sent.value.has(x.view(U))
                for i in np.flatnonzero(keep):
                    keep[i] = x[i] not in met
                    met.add(x[i])
                part = part.filter(pa.array(keep))
                if len(part):
                    sets = shingle_sets(part, size)
                    names, columns = zip(*of_set(sets).items())
                    yield pa.RecordBatch.from_arrays([part.column("x"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *columns], ["x", "doc_id", "n", *names])

    rows = text_rows(docs).where("doc_id is not null and text is not null").withColumn("x", F.xxhash64("doc_id", "_h"))
    return rows.select("x", "doc_id", "text").mapInArrow(run, f"x long, doc_id long, n long, {schema}")


def likely(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """x of the classes whose heads share enough shingles with other heads."""

    def heads(sets: list[np.ndarray]) -> dict:
        return {"head": lists([s[: len(s) - least(len(s), percent) + 1 + len(s) // EXTRA] for s in sets])}

    cut = materialize(_chosen(docs, classes.select(F.xxhash64("rep.doc_id", "rep._h").alias("x")), size, heads, "head array<long>"), "tiles-heads")
    posts = cut.select("x", F.explode("head").alias("v"))
    shared = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    agree = posts.join(shared, "v").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    # a partner has least(n) shingles or more, so that at least 1 + least(n)/EXTRA are shared
    enough = F.expr(f"c >= 1 + (n * {percent} + 99) div 100 div {EXTRA}")
    return agree.join(cut.select("x", "n").distinct(), "x").where(enough).select("x")


def full_sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(x, doc_id, n, set, bits) of the chosen classes."""

    def whole(sets: list[np.ndarray]) -> dict:
        return {"set": lists(sets), "bits": pa.array([bitmap(s).tobytes() for s in sets], pa.binary())}

    return _chosen(docs, keys, size, whole, "set array<long>, bits binary").dropDuplicates(["x"])


# ------------------------------------------------------------------ tiles

def need(n, m, percent: int):
    """The least overlap of linked sets of n and m shingles."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def tile_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(v, tile, x, home, n, own, top, pos): a set's rarest shingles that others have, too, and its
    bands of sizes; ``own``: shingles that only it has, ``top``: its largest possible partner,
    ``pos``: the shingle's place, rarest first."""
    each = sets.select("x", F.explode("set").alias("v"))
    shared = each.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rows = each.join(shared, "v").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs")).join(sets.select("x", "n"), "x")
    n, own = F.col("n"), F.col("own")
    some = F.expr(f"(n * {percent} + 99) div 100")
    rows = rows.withColumn("own", n - F.size("vs"))
    top = F.least(F.floor(n * 100 / percent), F.floor((n - own) * F.lit((100.0 + percent) / percent) + 1e-9) - n)
    rows = rows.withColumn("top", top).where(F.col("top") >= some).withColumn("long", (n - some + 1 - own).cast("int")).where("long > 0")
    rows = rows.select("x", "n", "own", "top", F.posexplode(F.slice("vs", F.lit(1), F.col("long"))).alias("i", "fv"))
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)))
    placed = F.explode(F.array(F.struct(band.alias("tile"), F.lit(True).alias("home")), F.struct((band + 1).alias("tile"), F.lit(False).alias("home"))))
    return rows.select(F.col("fv.v").alias("v"), "x", "n", "own", "top", (own + F.col("i")).alias("pos"), placed.alias("p")).select("v", "p.tile", "x", "p.home", "n", "own", "top", "pos")


def possible(a: str, b: str, percent: int):
    """What sizes and places allow, where v is the pair's first common shingle."""
    c = F.col
    rest = 1 + F.least(c(f"{a}.n") - c(f"{a}.pos") - 1, c(f"{b}.n") - c(f"{b}.pos") - 1)
    return (c(f"{a}.n") <= c(f"{b}.top")) & (c(f"{b}.n") <= c(f"{a}.top")) & (rest >= need(c(f"{a}.n"), c(f"{b}.n"), percent))


def bit_checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in ("n", "m"))
            keep = np.zeros(len(batch), bool)
            words = [np.array([len(v) // 8 for v in batch.column(k).to_pylist()]) for k in ("a", "b")]
            for wa, wb in set(zip(*(w.tolist() for w in words))):
                at = np.flatnonzero((words[0] == wa) & (words[1] == wb))
                a, b = (np.frombuffer(b"".join(batch.column(k).take(pa.array(at)).to_pylist()), U).reshape(len(at), -1) for k in ("a", "b"))
                most = overlap_bound(folded(a, min(wa, wb)), folded(b, min(wa, wb)), n[at], m[at])
                keep[at] = linked(most, n[at], m[at], percent)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    a = sets.select("x", "n", F.col("bits").alias("a"))
    b = sets.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("bits").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "n", "m", "a", "b").mapInArrow(run, "x long, y long")


def intersected(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of doc_ids: the pairs (x, y) that exact intersection confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(len(batch)):
                a, b = (batch.column(k)[i].values.to_numpy() for k in ("a", "b"))
                keep.append(linked(common(a, b), len(a), len(b), percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select("x", F.col("doc_id").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("x").alias("y"), F.col("doc_id").alias("v"), F.col("set").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _cell(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell, members of two chunks of a tile, whose signatures allow a link."""
    x, n, top, pos, component, chunk = (rows.column(k).to_numpy() for k in ("x", "n", "top", "pos", "component", "chunk"))
    home = rows.column("home").to_numpy()
    low = chunk == rows.column("i")[0].as_py()
    one = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    left, right = np.flatnonzero(low), np.flatnonzero(low if one else ~low)
    bits = rows.column("bits").to_pylist()
    words = min(len(b) for b in bits) // 8
    sigs = np.concatenate([folded(np.frombuffer(b, U)[None, :], words) for b in bits])
    out: list[np.ndarray] = [x[:0]], [x[:0]]
    for k, i in enumerate(left):
        j = right[k + 1 :] if one else right
        j = j[(component[j] != component[i]) & (home[j] | home[i]) & (n[j] <= top[i]) & (n[i] <= top[j])]
        j = j[linked(1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1), n[i], n[j], percent)]
        j = j[linked(overlap_bound(sigs[i], sigs[j], n[i], n[j]), n[i], n[j], percent)]
        out[0].append(np.full(len(j), x[i]))
        out[1].append(x[j])
    return np.concatenate(out[0]), np.concatenate(out[1])


def cell_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of members of one tile in different components that the bit counts allow.
    ``open_``: tile rows with their component."""
    spread = open_.groupBy("v", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi")
    chunks = F.ceil(F.col("k") / F.lit(CELL)).cast("long")
    rows = open_.join(spread.select("v", "tile", chunks.alias("chunks")), ["v", "tile"]).withColumn("chunk", F.expr("pmod(xxhash64(x, v), chunks)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    rows = materialize(rows.withColumn("cell", F.xxhash64("v", "tile", "i", "j")).select("cell", "i", "j", "chunk", "x", "home", "n", "top", "pos", "component"), "tiles-cells")
    groups = max(1, -(-rows.count() // GROUP))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell").combine_chunks()
        cell = group.column("cell").to_numpy()
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        pairs = [_cell(group.slice(a, b - a), percent) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cell)]) if b - a > 1]
        return pa.table([pa.array(np.concatenate([p[k] for p in pairs]) if pairs else [], pa.int64()) for k in (0, 1)], ["x", "y"])

    grouped = rows.join(sets.select("x", "bits"), "x").groupBy(F.pmod("cell", F.lit(groups)).alias("g"))
    return grouped.applyInArrow(run, "x long, y long")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of doc_ids that connect what is linked: stars first, then cells across components."""
    listed = materialize(tile_rows(sets, percent), "tiles-rows")
    centre = listed.groupBy("v", "tile").agg(F.min(F.struct("own", "x", "n", "pos", "top")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select("v", "tile", "c.*")
    star = listed.alias("a").join(centre.alias("b"), ["v", "tile"]).where((F.col("a.x") != F.col("b.x")) & possible("a", "b", percent))
    star = star.select(F.least("a.x", "b.x").alias("x"), F.greatest("a.x", "b.x").alias("y")).distinct()
    first = materialize(intersected(bit_checked(star, sets, percent), sets, percent), "tiles-links")
    label = components(first).select(F.col("node").alias("doc_id"), "component")
    known = sets.select("x", "doc_id").join(label, "doc_id", "left").select("x", F.coalesce("component", "doc_id").alias("component"))
    open_ = materialize(listed.join(known, "x"), "tiles-open")
    cross = cell_pairs(open_, sets, percent).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return first.unionByName(intersected(cross, sets, percent))


# ------------------------------------------------------------------ documents

def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, _h, n_shingles, component_id."""
    rows = materialize(_rows(docs, size), "tiles-documents")
    sets = rows.where("n > 0 and doc_id is not null")
    key = ["n", "s", "t"]
    classes = materialize(sets.groupBy(*key).agg(F.min(F.struct("doc_id", "_h")).alias("rep"), F.count(F.lit(1)).alias("c")), "tiles-classes")
    chosen = materialize(full_sets(docs, materialize(likely(docs, classes, size, percent), "tiles-likely"), size), "tiles-sets")
    edges = links(chosen, percent)
    # an id with several sets links their classes
    several = sets.select("doc_id", *key).distinct()
    several = several.join(several.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id").join(classes, key)
    label = components(edges.union(several.select(F.col("rep.doc_id").alias("u"), F.col("doc_id").alias("v"))))
    # only classes of several members, or with links, differ from their documents' own ids
    named = classes.select(*key, "c", F.col("rep.doc_id").alias("node")).join(label, "node", "left").where("c > 1 or component is not null")
    named = named.select(*key, F.coalesce("component", "node").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)).cast("int"))
    found = salted.join(named, [*key, "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "_h", F.col("n").alias("n_shingles"), component.alias("component_id"))
