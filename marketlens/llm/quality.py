"""Operator 1: quality classifier with hierarchical empirical-Bayes site priors.

1. A document classifier turns each text into evidence: two logistic heads (low quality,
   toxic) over surface measurements and the log-odds of words and word beginnings.  It is
   fitted on a bounded sample of labelled ids (``TRAIN_DOCS``, a parameter), dealt evenly over
   the kinds of label, so that a rare kind is there as a whole or with its full part; the
   heads' constants are corrected to the rates among all labelled ids.
2. Grouped aggregation sums the evidence of all documents per path and per host.
   A host's rate of bad documents is shrunk towards the global rate, a path's towards
   its host's; how strongly is estimated from the spread between hosts (between paths)
   by the method of moments, so a sparse site stays near its prior.
3. The site's log-odds shift moves each document's evidence; the document's own share is
   taken out of its path's sums first.  A document whose posterior exceeds ``THRESHOLD``
   is rejected.

Scale: one scan for the sampled rows, one for the evidence; the aggregations move one row
per site and task (a hot host is one partial sum per task); texts are not shuffled.  Site
rates are joined by Spark's choice of strategy, since the number of sites is not bounded.

Defined results: null and empty texts are scored like any text (no words, no letters);
null source or lang is a site of its own; documents without a label are scored the same;
repeated label rows count once, the worst label wins, null labels are taken as good;
without any labelled document of both kinds the classifier says the global rate; repeated
rows are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import columns, free_names, materialize, same_row, slices
from marketlens.llm.textvec import LOWER, U, Words, run_hash, signed, span_hash

#: At most so many labelled documents are used to fit the classifier.
TRAIN_DOCS = 10_000
#: Size of the word lexicon of each head, and the documents a word must occur in.
LEXICON, LEXICON_MIN_DOCS = 4096, 5
THRESHOLD = 0.5
#: Word beginnings of these many bytes are evidence besides whole words.
BEGINNINGS = (4, 5, 6, 7)
HEADS = ("low", "toxic")


def _letters() -> np.ndarray:
    """Like LOWER, with ASCII punctuation and digits as separators."""
    table = LOWER.copy()
    table[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
    return table


LETTERS = _letters()
N_SURFACE = 13


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values within consecutive bounds (empty ranges: 0)."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct_share(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values per value, in each range."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return np.bincount(row[order][new], minlength=len(n)) / np.maximum(n, 1)


class Measured:
    """Surface measurements and word features of a batch of texts."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, LETTERS)
        raw, bounds = words.raw, words.offsets
        size = np.maximum(np.diff(bounds), 1)
        n = np.diff(words.first)
        self.first, self.hash = words.first, words.hash

        def share(mask: np.ndarray) -> np.ndarray:
            return per_text(mask, bounds) / size

        upper = (raw >= 0x41) & (raw <= 0x5A)
        other = (raw > 0x20) & (raw < 0x80) & (words.data == 0)
        digit = (raw >= 0x30) & (raw <= 0x39)
        gentle = np.isin(raw, np.frombuffer(b".,;:'\"-()?", np.uint8))
        pairs = run_hash(self.hash, i := np.arange(max(0, len(self.hash) - 1)), i + 2)
        pair_bounds = np.minimum(words.first, len(pairs))
        same = np.zeros(len(self.hash), bool)
        same[1:] = self.hash[1:] == self.hash[:-1]
        lines = per_text(raw == 0x0A, bounds) + 1
        distinct = distinct_share(self.hash, words.first)
        columns = [
            np.log1p(n),
            np.minimum(per_text(words.end - words.start, words.first) / np.maximum(n, 1), 30),
            share(upper),
            share(other & ~gentle & ~digit),
            share(digit),
            share(raw == 0x7C),
            share(raw == 0x21),
            share(gentle),
            share((raw == 0x20) | (raw == 0x0A)),
            distinct,
            distinct_share(pairs, pair_bounds),
            per_text(same, words.first) / np.maximum(n, 1),
            np.log1p(lines),
        ]
        self.surface = np.column_stack(columns)
        self.data, self.start, self.end = words.data, words.start, words.end

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word index, feature hash): whole words, then word beginnings of each size."""
        every = np.arange(len(self.hash))
        yield every, self.hash
        for n in BEGINNINGS:
            at = np.flatnonzero(self.end - self.start > n)
            yield at, span_hash(self.data, self.start[at], self.start[at] + n) ^ U(0xA5A5_0000 + n)


@dataclass
class Model:
    """Bounded arrays: per head a sorted lexicon with log-odds, and the logistic weights."""

    lexicon: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray  # heads x (1 + features)
    center: np.ndarray
    scale: np.ndarray

    def matrix(self, m: Measured) -> np.ndarray:
        n_words = np.maximum(np.diff(m.first), 1)
        row = np.repeat(np.arange(len(n_words)), np.diff(m.first))
        parts = [m.surface]
        seen = list(m.features())
        for known, odds in self.lexicon:
            best = np.zeros(len(m.hash))
            if len(known):
                quick = np.zeros(1 << 16, bool)
                quick[(known >> U(48)).astype(np.int64)] = True
                for at, h in seen:
                    some = np.flatnonzero(quick[(h >> U(48)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
                    some, place = some[known[place] == h[some]], place[known[place] == h[some]]
                    best[at[some]] = np.maximum(best[at[some]], odds[place])
            strong = best > 2
            total = np.bincount(row, weights=best, minlength=len(n_words))
            peak = np.zeros(len(n_words))
            np.maximum.at(peak, row[best > 0], best[best > 0])
            hits = np.bincount(row[strong], minlength=len(n_words))
            parts.append(np.column_stack([peak, np.log1p(hits), hits / n_words, total / n_words]))
        return np.column_stack(parts)

    def predict(self, m: Measured) -> np.ndarray:
        """Rows x heads: probabilities."""
        x = (self.matrix(m) - self.center) / self.scale
        z = np.column_stack([np.ones(len(x)), np.clip(x, -20, 20)]) @ self.weights.T
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, stands_for: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method (the constant is not penalised).  A row
    stands for so many labelled ids: that weighs rows within a class, and the constant
    moves from the rates of the rows to those of the ids."""
    x = np.column_stack([np.ones(len(x)), x])
    mean = np.array([stands_for[y == k].mean() if (y == k).any() else 1.0 for k in (0, 1)])
    weight = stands_for / mean[y.astype(np.int64)]
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(rate / (1 - rate))
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[0] += np.log(mean[1] / mean[0])
    return w


def deal(sizes: list[int], limit: int) -> list[int]:
    """``limit`` places dealt evenly over groups, what a small group leaves going to the others."""
    out = [0] * len(sizes)
    left = limit
    for done, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - done))
        left -= out[i]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, low, toxic, stands_for, text) of at most ``limit`` labelled ids, chosen by a hash
    of the id within each kind of label; each stands for so many ids of its kind."""
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("low"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    kinds = bad.groupBy(*HEADS).agg(F.count(F.lit(1)).alias("n")).orderBy(*HEADS).collect()
    chosen = bad.where(F.lit(False)).withColumn("stands_for", F.lit(1.0))
    for kind, quota in zip(kinds, deal([k["n"] for k in kinds], limit)):
        rows = bad.where((F.col("low") == kind["low"]) & (F.col("toxic") == kind["toxic"]))
        # thin out by the hash first, so that the last task gets few more rows than the limit
        share = min(1.0, (1.2 * quota + 50) / kind["n"])
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(quota)
        chosen = chosen.union(rows.withColumn("stands_for", F.lit(kind["n"] / max(1, quota))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit the document classifier: lexicons by grouped counts, then the logistic heads."""
    rows = materialize(training_rows(docs, labels, limit), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = Measured(part.column("text"))
                row = np.repeat(np.arange(len(part)), np.diff(m.first))
                y = np.column_stack([part.column(h).to_numpy(zero_copy_only=False) for h in HEADS])
                hs, rs = [], []
                for at, h in m.features():
                    pair = np.unique(np.stack([h, row[at].astype(U)], 1), axis=0)
                    hs.append(pair[:, 0])
                    rs.append(pair[:, 1].astype(np.int64))
                h, r = np.concatenate(hs), np.concatenate(rs)
                feature, at = np.unique(h, return_inverse=True)
                sums = [np.bincount(at, minlength=len(feature))] + [np.bincount(at, weights=y[r, k], minlength=len(feature)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(feature)), *(pa.array(s.astype(np.int64)) for s in sums)], ["feature", "n", "low", "toxic"])

    counts = rows.mapInArrow(count, "feature long, n long, low long, toxic long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic")))
    counts = counts.where(F.col("n") >= LEXICON_MIN_DOCS)
    base = rows.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in HEADS)).first()
    lexicon = []
    for h in HEADS:
        rate = (base[h] + 0.5) / (base["n"] + 1)
        odds = F.log((F.col(h) + rate * 2) / (F.col("n") - F.col(h) + (1 - rate) * 2)) - float(np.log(rate / (1 - rate)))
        top = counts.select("feature", odds.alias("odds"), "n").where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.log(F.col("n"))), "feature").limit(LEXICON)
        top = columns(top)
        order = np.argsort(top["feature"].view(U))
        lexicon.append((top["feature"].view(U)[order], top["odds"][order]))
    blank = Model(lexicon, np.zeros((2, 1)), np.zeros(1), np.ones(1))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = blank.matrix(Measured(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *(part.column(c) for c in (*HEADS, "stands_for"))], ["x", *HEADS, "stands_for"])

    sample = rows.mapInArrow(matrix, "x array<double>, low int, toxic int, stands_for double").toArrow()
    width = N_SURFACE + 4 * len(HEADS)
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
    center = x.mean(0) if len(x) else np.zeros(width)
    scale = np.where((s := x.std(0) if len(x) else np.ones(width)) > 1e-9, s, 1.0)
    stands_for = sample.column("stands_for").to_numpy()
    weights = np.vstack([logistic(np.clip((x - center) / scale, -20, 20), sample.column(h).to_numpy().astype(np.float64), stands_for) for h in HEADS])
    return Model(lexicon, weights, center, scale)


def site_columns(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host, and path within it: the source up to its first slash and the part after that;
    a source without a path is divided by language instead."""
    plain = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[A-Za-z]+://", "")
    section = F.regexp_extract(plain, r"^[^/]*/([^/]+)", 1)
    return F.regexp_extract(plain, r"^([^/]*)", 1), F.when(section != "", section).otherwise(F.coalesce(lang.cast("string"), F.lit("")))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, _h, host, path, p_low, p_toxic): the classifier's view of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = sent.value.predict(Measured(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "_h", "host", "path")), pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "_h", "host", "path", "p_low", "p_toxic"])

    text = F.col("text").cast("string")
    host, path = site_columns(F.col("source"), F.col("lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), host.alias("host"), path.alias("path"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, _h long, host string, path string, p_low double, p_toxic double")


def _spread(rate: Column, prior: Column) -> Column:
    """Method of moments: prior strength (pseudo-documents) from how far the sites' rates
    differ from their prior beyond what sampling alone explains."""
    far = F.sum(F.col("n") * (rate - prior) ** 2) / F.sum("n")
    noise = F.sum(prior * (1 - prior)) / F.sum("n")
    between = F.greatest(far - noise, F.lit(1e-6))
    return F.least(F.greatest(F.avg(prior * (1 - prior)) / between - 1, F.lit(1.0)), F.lit(1e6))


def decide(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Site posteriors joined back to the evidence: p_bad, host_rate, path_rate, p_reject, kept."""
    bad = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    rows = rows.withColumn("p_bad", F.least(F.greatest(bad, F.lit(1e-6)), F.lit(1 - 1e-6)))
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_bad").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("rate")).first()["rate"]
    rate, prior = F.col("s") / F.col("n"), F.lit(float(total))
    strength = hosts.agg(F.coalesce(_spread(rate, prior), F.lit(1.0)).alias("k")).first()["k"]
    hosts = hosts.select("host", ((F.col("s") + strength * total) / (F.col("n") + strength)).alias("host_rate"))
    sites = paths.join(hosts, "host")
    inner = sites.agg(F.coalesce(_spread(rate, F.col("host_rate")), F.lit(1.0)).alias("k")).first()["k"]
    joined = rows.join(sites, ["host", "path"])
    path_rate = (F.col("s") - F.col("p_bad") + inner * F.col("host_rate")) / (F.col("n") - 1 + inner)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))

    def logit(p: Column) -> Column:
        return F.log(p / (1 - p))

    shift = logit(path_rate) - float(np.log(total / (1 - total)) if 0 < total < 1 else 0.0)
    z = logit(F.col("p_bad")) + shift
    out = joined.select("doc_id", "_h", "host", "path", "p_low", "p_toxic", "host_rate", path_rate.alias("path_rate"), (1 / (1 + F.exp(-z))).alias("p_reject"))
    return out.withColumn("kept", F.col("p_reject") <= threshold)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Decision for every row of ``docs``."""
    model = train(docs, labels, train_docs)
    return decide(materialize(evidence(docs, model), "quality-evidence"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; rows of one id
    and text stay together if one of them is kept."""
    id_, h = free_names(docs, "kept_id", "kept_hash")
    kept = classify(docs, labels).where("kept").select(F.col("doc_id").alias(id_), F.col("_h").alias(h)).distinct()
    return docs.join(kept, same_row(docs, id_, h), "left_semi")
