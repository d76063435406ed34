"""Operator 12: the highest-scoring documents of each item, by the Best Position Algorithm.

Scores are integers.  Terms are runs of ASCII letters (lower-cased), digits and non-ASCII
characters.  Of N documents with terms, L terms in all, n in this document, df documents with the
term and tf occurrences: a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document's length
counts as m = 75 + 25nN div L, and the score sums w * (10^9 tf div (1000 tf + 12m)) over the item's
terms, repeats included.

1. One scan of the documents counts terms and keeps those that some item has (a bitmap of
   the items' terms goes to the tasks; a term that passes it wrongly meets no item later).  N, L and
   the documents' frequencies are sums over all documents.
2. Documents are dealt evenly to shards of about ``SHARD`` postings, items to blocks of about
   ``BLOCK`` terms; every pair of them is one group of a cogroup.
3. A group has one list for each term, by falling impact, and by document for direct accesses.
   An item reads its lists side by side; each document met is scored at once by
   direct accesses to the item's other lists, and its places there count as seen.  A list's best
   position is the end of its unbroken run of seen places.  What has not been
   seen lies beyond it in every list, so the impacts that follow the best positions sum to a
   bound for every unseen document, tighter than one from the last places read.  The item stops when
   the bound is strictly below its k-th score (an equal one could win by its id).
4. The groups' best documents of an item are ranked; k of them stay.

Scale: a shard's work does not grow with the table, and a term in a third of all documents is spread
over all shards.  What leaves a group is k rows an item.  The driver sees three sums and
the bitmap (``common.KeyBitmap``, fixed size).

Defined results: null or wordless texts have no terms, are not counted and not returned; every
row is a document of its own, repeated rows and ids included; equal scores are ordered by id, rows without an id last; repeated items
(same id and text) are one, different texts under one id have a list each; an item without terms or
matches, and an empty table, give no rows; other columns are ignored.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm.common import KeyBitmap, materialize, slices, text_rows
from marketlens.llm.textvec import ALNUM, U, Words, signed

#: Postings of a shard and item terms of a block.
SHARD, BLOCK = 1_000_000, 50_000
#: Places read from each list in the first round; every round doubles the depth.
FIRST = 32


def term_counts(part: pa.RecordBatch, chosen: KeyBitmap | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; bounds, hashes and counts of each text's distinct (chosen) terms."""
    words = Words(part.column("text"), ALNUM)
    n = np.diff(words.first)
    row, term = np.repeat(np.arange(len(n)), n), words.hash
    if chosen is not None:
        keep = chosen.has(term)
        row, term = row[keep], term[keep]
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(head)
    bounds = np.searchsorted(row[at], np.arange(len(n) + 1))
    return n, bounds, term[at], np.diff(np.append(at, len(row)))


def _counted(rows: DataFrame, columns: list[str], chosen: KeyBitmap | None) -> DataFrame:
    """The columns and (n, terms, counts) of each row with terms."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, bounds, terms, counts = term_counts(part, sent.value)
                ends = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (signed(terms), counts.astype(np.int32))]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n.astype(np.int64)), *lists], [*columns, "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return rows.select(*columns, "text").mapInArrow(run, ", ".join([*(f"{c} long" for c in columns), "n long", "terms array<long>", "counts array<int>"]))


class Lists:
    """Postings of a shard by term: documents ascending, with impacts and places by falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, term, self.impact = doc[order], term[order], impact[order]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        self.fall = np.lexsort((-self.impact, term))
        self.place = np.empty(len(doc), np.int64)
        self.place[self.fall] = np.arange(len(doc)) - self.start[term]
        self.n_docs = n_docs

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest-scoring documents with a score above 0: (documents, scores), best first,
        equal scores by ascending document."""
        filled = self.start[terms + 1] > self.start[terms]
        lists = [(int(self.start[t]), int(self.start[t + 1]), int(w)) for t, w in zip(terms[filled], weights[filled]) if w > 0]
        seen = [np.zeros(hi - lo, bool) for lo, hi, _ in lists]
        best = [0] * len(lists)
        met = np.zeros(self.n_docs, bool)
        docs, totals = np.zeros(0, self.doc.dtype), np.zeros(0, np.int64)
        depth, step = 0, FIRST
        while lists:
            read = np.concatenate([self.doc[self.fall[min(lo + depth, hi) : min(lo + depth + step, hi)]] for lo, hi, _ in lists])
            new = np.unique(read[~met[read]])
            met[new] = True
            total = np.zeros(len(new), np.int64)
            bound = 0
            for i, (lo, hi, w) in enumerate(lists):
                if len(new):  # direct accesses
                    at = np.searchsorted(self.doc[lo:hi], new)
                    hit = np.flatnonzero(self.doc[lo:hi][np.minimum(at, hi - lo - 1)] == new)
                    at = at[hit] + lo
                    total[hit] += w * self.impact[at]
                    seen[i][self.place[at]] = True
                rest = seen[i][best[i] :]
                ahead = int(rest.argmin()) if len(rest) else 0
                best[i] += ahead if len(rest) and not rest[ahead] else len(rest)
                if best[i] < hi - lo:
                    bound += w * int(self.impact[self.fall[lo + best[i]]])
            docs, totals = np.append(docs, new), np.append(totals, total)
            if len(docs) > k:  # only the best so far can stay
                top = np.lexsort((docs, -totals))[:k]
                docs, totals = docs[top], totals[top]
            if bound == 0 or len(docs) >= k and bound < int(totals.min()):
                break
            depth, step = depth + step, depth + step
        top = np.lexsort((docs, -totals))
        top = top[totals[top] > 0]
        return docs[top], totals[top]


def _search(left: pa.Table, right: pa.Table, n_all: int, l_all: int, k: int) -> pa.Table:
    """One shard's best documents for one block's items."""
    out: list[list] = [[], [], [], []]
    if len(left) and len(right):
        left = left.sort_by([("doc_id", "ascending")]).combine_chunks()  # rows without an id last
        right = right.sort_by([("x", "ascending")])
        wanted = np.unique(right.column("term").to_numpy())
        lists = left.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(left), dtype=np.int32), sizes)
        term, tf = lists.flatten().to_numpy(), left.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        place = np.searchsorted(wanted, term)
        keep = wanted[np.minimum(place, len(wanted) - 1)] == term
        doc, place, tf = doc[keep], place[keep], tf[keep]
        m = np.array([75 + 25 * n * n_all // l_all for n in left.column("n").to_pylist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        index = Lists(doc, place, impact, len(left), len(wanted))
        ids = left.column("doc_id").combine_chunks()
        x, item = right.column("x").to_numpy(), right.column("item_id").combine_chunks()
        at = np.searchsorted(wanted, right.column("term").to_numpy())
        weights = right.column("weight").to_numpy()
        edges = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(x))):
            docs, totals = index.best(at[a:b], weights[a:b], k)
            out[0].append(np.full(len(docs), x[a]))
            out[1] += [item[int(a)].as_py()] * len(docs)
            out[2].append(docs)
            out[3].append(totals)
        taken = ids.take(pa.array(np.concatenate(out[2]).astype(np.int64)))
        return pa.table([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(out[1], pa.int64()), taken, pa.array(np.concatenate(out[3]), pa.int64())], ["x", "item_id", "doc_id", "score"])
    return pa.table([pa.array([], pa.int64())] * 4, ["x", "item_id", "doc_id", "score"])


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.distinct().withColumn("x", F.xxhash64("item_id", "text"))
    asked = _counted(texts, ["x", "item_id"], None).select("x", "item_id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    asked = materialize(asked.select("x", "item_id", F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("q")), "ranked-items")
    found = materialize(_counted(text_rows(docs), ["doc_id"], KeyBitmap(asked, "term")), "ranked-documents")
    n_all, l_all, postings = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()

    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_all + 2) / (2 * F.col("df") + 1).cast("double")))
    wanted = asked.join(df, "term").select("x", "item_id", "term", (F.col("q") * weight).alias("weight"))
    n_shards = max(1, -(-postings // SHARD))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)).alias("shard")
    left = found.where(F.size("terms") > 0).select("*", shard).select("*", each(n_blocks).alias("block"))
    right = wanted.select("*", F.pmod("x", F.lit(n_blocks)).alias("block"), each(n_shards).alias("shard"))
    pairs = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    best = pairs.applyInArrow(lambda a, b: _search(a, b, n_all, l_all, k), "x long, item_id long, doc_id long, score long")
    order = Window.partitionBy("x").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
with docs as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents where text is not null
), sizes as (
  select r, doc_id, cast(len(terms) as bigint) as n from docs where len(terms) > 0
), totals as (
  select count(*) as n_all, cast(sum(n) as bigint) as l_all from sizes
), wanted as (
  select item_id, text, term, count(*) as q
  from (select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark where text is not null))
  group by item_id, text, term
), counted as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from docs)
  where term in (select term from wanted) group by r, term
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * any_value(n_all) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from counted, totals group by term
), scored as (
  select item_id, text, r, doc_id,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_all) // l_all)))) as score
  from wanted join weights using (term) join counted using (term) join sizes using (r), totals
  group by item_id, text, r, doc_id
), ranked as (
  select item_id, doc_id, score,
         row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank
  from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 20
"""
