"""Operator 2: near-duplicate groups from bottom-k sketches with one hash function.

A document's set is its distinct word shingles, as 64-bit hashes; its sketch is the
``SKETCH`` smallest of them.  Documents are linked if 100 * |A and B| >= 80 * |A or B|.

1. Equal sets (equal size and two 64-bit signatures) form a class with one representative (its smallest
   doc_id), so thousands of copies are one set from here on.
2. Inverted lists of the sketch values: a class goes on only if at least ``AGREE`` of its
   ``SKETCH`` retained values are retained by another class, too.  A linked pair is expected
   to agree in 0.8 of the union sketch, so a link is missed here with probability below
   1e-13; classes of fewer shingles have whole sets as sketches and a lower bar in proportion.
3. The same lists generate pairs: every member of a list meets the list's most central one, which has
   the fewest retained values of its own, so that a group of copies costs a star and not all its
   pairs.  Each pair passes the union-sketch estimate, then exact Jaccard on the full sets.
4. The exact remainder: a pair that is linked must share one of the ``n - ceil(0.8 n) + 1`` rarest
   shingles of either full set; with a shingle's place in that order and the number of shingles that
   no other class has, each pair's possible overlap is bounded before it is formed.  Lists of these shingles
   whose members are still in different components get a star of their own, and after it
   pairs across components; estimate and exact Jaccard as before.
5. Links are contracted to components (``graph``).

Scale: no list is collected; a list's centre is a partial aggregate and its members meet
it in a join that AQE can split.  Full sets are read again and moved for the classes of
step 2 only.  Intermediate tables go to the shared folder; the driver sees counts.

Defined results: a text of fewer words than a shingle is one shingle; null, empty or blank
text has the empty set and is linked with nothing; a null doc_id is linked with nothing,
has a null component and is kept; rows with one doc_id are one document with several
sets, all linked; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm.common import KeyBitmap, free_names, materialize, slices, text_rows
from marketlens.llm.graph import components
from marketlens.llm.textvec import LOWER, U, Words, grams, mix, run_hash, signed

SKETCH, AGREE = 48, 15
#: Copies of a class row that its members are dealt over.
SALT = 16


def shingle_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    words = Words(part.column("text"), LOWER)
    g = grams(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        else:
            out.append(run_hash(words.hash[a:b], np.array([0]), np.array([b - a])) if b > a else g[:0])
    return out


def signature(s: np.ndarray, seed: int) -> int:
    """64-bit hash of a set (order does not matter)."""
    with np.errstate(over="ignore"):
        return int(signed(mix(np.array([mix(s ^ U(seed)).sum(dtype=U) + U(len(s))], U)))[0])


SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, _h, n, sig, sig2, sketch) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_h"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([signature(s, seed) for s in sets], pa.int64()) for seed in SEEDS), lists([s[:SKETCH] for s in sets])],
                    ["doc_id", "_h", "n", "sig", "sig2", "sketch"],
                )

    return text_rows(docs).mapInArrow(run, "doc_id long, _h long, n long, sig long, sig2 long, sketch array<long>")


def full_sets(docs: DataFrame, chosen: KeyBitmap, size: int) -> DataFrame:
    """(x, doc_id, n, set) of the chosen rows; x tells rows apart."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                part = part.filter(pa.array(sent.value.has(part.column("x").to_numpy(zero_copy_only=False).view(U))))
                if not len(part):
                    continue
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), lists(sets)], ["x", "doc_id", "n", "set"])

    rows = text_rows(docs).where("doc_id is not null and text is not null").withColumn("x", F.xxhash64("doc_id", "_h"))
    return rows.select("x", "doc_id", "text").mapInArrow(run, "x long, doc_id long, n int, set array<long>")


def likely_classes(one: DataFrame) -> DataFrame:
    """(x, alone) of the classes that share enough retained values with others; ``alone``: values that they do not share."""
    posts = one.select("x", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    agreeing = posts.join(shared, "v").groupBy("x", "s").agg(F.count(F.lit(1)).alias("c"))
    return agreeing.where(F.col("c") * SKETCH >= F.col("s") * AGREE).select("x", (F.col("s") - F.col("c")).alias("alone"))


def retained_pairs(one: DataFrame, likely: DataFrame) -> DataFrame:
    """(x, y): members and centres of the lists of retained values."""
    posts = materialize(one.join(likely, "x").select("x", "alone", F.explode("sketch").alias("v")), "minhash-retained")
    centre = posts.groupBy("v").agg(F.min(F.struct("alone", "x")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select("v", F.col("c.x").alias("y"))
    return posts.join(centre, "v").where("x <> y").select("x", "y").distinct()


def need(n, m, percent: int):
    """The least overlap of linked sets of n and m shingles."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(v, x, doc_id, n, own, top, pos): each set's rarest shingles; ``own``: how many it has
    alone, ``top``: the largest partner it can be linked with, ``pos``: place in rarity order."""
    each = sets.select("x", "doc_id", "n", F.explode("set").alias("v"))
    shared = each.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rows = each.join(shared, "v").groupBy("x").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"))
    n, own = F.col("n"), F.col("own")
    rows = rows.withColumn("own", n - F.size("vs"))
    # overlap <= n - own, and at least percent/(100+percent) of both sizes together
    top = F.least(F.floor(n * 100 / percent), F.floor((n - own) * F.lit((100.0 + percent) / percent) + 1e-9) - n)
    rows = rows.withColumn("top", top).where(F.col("top") >= F.ceil(n * percent / F.lit(100.0) - 1e-9))
    length = n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1 - own
    rows = rows.where(length > 0).select("x", "doc_id", "n", "own", "top", F.posexplode(F.slice("vs", F.lit(1), length.cast("int"))).alias("i", "fv"))
    return rows.select(F.col("fv.v").alias("v"), "x", "doc_id", "n", "own", "top", (F.col("own") + F.col("i")).alias("pos"))


def possible(a: str, b: str, percent: int):
    """Bounds that a linked pair's first common listed shingle meets."""
    c = F.col
    rest = 1 + F.least(c(f"{a}.n") - c(f"{a}.pos") - 1, c(f"{b}.n") - c(f"{b}.pos") - 1)
    return (c(f"{a}.n") <= c(f"{b}.top")) & (c(f"{b}.n") <= c(f"{a}.top")) & (rest >= need(c(f"{a}.n"), c(f"{b}.n"), percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of doc_ids: pairs (x, y) that pass the union-sketch estimate and exact Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(len(batch)):
                a = batch.column("a")[i].values.to_numpy().view(U)
                b = batch.column("b")[i].values.to_numpy().view(U)
                low_a, low_b = a[:SKETCH], b[:SKETCH]
                union = np.union1d(low_a, low_b)[:SKETCH]
                agree = len(np.intersect1d(np.intersect1d(low_a, low_b, True), union, True))
                if agree * SKETCH < AGREE * len(union):
                    continue
                both = len(np.intersect1d(a, b, True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    a = sets.select("x", F.col("doc_id").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("x").alias("y"), F.col("doc_id").alias("v"), F.col("set").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def open_lists(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """The lists whose members are in different components, with these."""
    label = components(edges).select(F.col("node").alias("doc_id"), "component")
    known = listed.drop("component").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = known.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v")
    return materialize(known.join(split, "v"), "minhash-open")


def links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Edges that connect what is linked: the pairs of the retained values, then stars and pairs of what these leave apart."""
    first = materialize(verified(pairs, sets, percent), "minhash-links")
    apart = open_lists(postings(sets, percent), first)
    centre = apart.groupBy("v").agg(F.min(F.struct("own", "x", "n", "pos", "top", "component")).alias("c")).select("v", "c.*")
    star = apart.alias("a").join(centre.alias("b"), "v").where((F.col("a.component") != F.col("b.component")) & possible("a", "b", percent))
    second = verified(star.select(F.col("a.x").alias("x"), F.col("b.x").alias("y")).distinct(), sets, percent)
    second = materialize(first.unionByName(second), "minhash-links")
    rest = open_lists(apart, second)
    cross = rest.alias("a").join(rest.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.component") < F.col("b.component")) & possible("a", "b", percent))
    third = verified(cross.select(F.col("a.x").alias("x"), F.col("b.x").alias("y")).distinct(), sets, percent)
    return second.unionByName(third)


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, _h, n_shingles, component_id, kept."""
    rows = materialize(sketches(docs, size), "minhash-sketches")
    sets = rows.where("n > 0 and doc_id is not null")
    key = ["sig", "sig2", "n"]
    classes = sets.groupBy(*key).agg(F.min(F.struct("doc_id", "_h")).alias("rep"), F.count(F.lit(1)).alias("c"))
    classes = materialize(classes, "minhash-classes")
    one = sets.join(classes.select("rep.*"), ["doc_id", "_h"], "left_semi").select(F.xxhash64("doc_id", "_h").alias("x"), "sketch")
    one = materialize(one.dropDuplicates(["x"]), "minhash-representatives")
    likely = materialize(likely_classes(one), "minhash-likely")
    chosen = materialize(full_sets(docs, KeyBitmap(likely, "x"), size), "minhash-sets")
    edges = links(chosen, retained_pairs(one, likely), percent)
    # only classes of several members differ from their documents' own ids; their members are dealt over SALT copies of the class
    named = classes.where("c > 1").select(*key, F.col("rep.doc_id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)).cast("int"))
    member = salted.join(named, [*key, "salt"], "left").select("doc_id", "_h", F.coalesce("rep", "doc_id").alias("rep"))
    member = materialize(member, "minhash-members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    same_id = several.select(F.col("lo").alias("u"), F.col("doc_id").alias("v")).union(several.select("hi", "doc_id"))
    same_id = same_id.union(member.join(several.select("doc_id"), "doc_id").select("rep", "doc_id"))
    label = components(edges.union(same_id))
    label = member.select("doc_id", "_h", "rep").distinct().join(label, F.col("rep") == F.col("node"), "left")
    label = label.select(F.col("doc_id").alias("__id"), F.col("_h").alias("__h"), F.coalesce("component", "rep").alias("component_id"))
    found = rows.select("doc_id", "_h", "n").join(label, (F.col("doc_id") == F.col("__id")) & (F.col("_h") == F.col("__h")), "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "_h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group (of its smallest doc_id); rows without an id stay."""
    id_, h, n = free_names(docs, "kept_id", "kept_hash", "kept_nth")
    kept = groups(docs, size, percent).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.min("_h").alias(h))
    tagged = docs.withColumns({id_: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    nth = F.row_number().over(Window.partitionBy(id_, h).orderBy(h))
    one = tagged.where(F.col(id_).isNotNull()).join(kept, [id_, h], "left_semi").withColumn(n, nth).where(F.col(n) == 1)
    return one.select(docs.columns).union(tagged.where(F.col(id_).isNull()).select(docs.columns))
