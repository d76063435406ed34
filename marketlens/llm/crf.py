"""Operator 3: language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over languages.  A word's features are its first
and last one to three bytes, its byte trigrams and the language lexicons it is in; each has
a learned weight per language, and neighbouring words are tied by learned transition weights.
Forward-backward gives the marginals; a text's language is the one with the largest mean
marginal over its words with letters, and ``runs`` are the stretches of words of one language.

Learning: about ``TRAIN_DOCS`` whole texts of every value of lang outside the held-out fold,
picked by a hash of the id, of any length; only their text and lang are used.  All languages
share ``SAMPLE_BYTES`` evenly, and each has one text at least, however long.
Their words are dealt into sequences that switch language every few words, so that the
transitions are learnt for code-switched text, and the conditional likelihood is raised by
stochastic gradient steps.  The model is a table of ``TABLE`` rows and one column per language,
sent to every task.

Scale: one scan for the sample, one for the predictions, no shuffle of texts.  Inside a task
all features of a slice are looked up at once, and forward-backward steps through all texts
of the slice side by side.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when there
is nothing to learn from; a null doc_id belongs to no fold, is not learned from and not held
out; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import SLICE_BYTES, crc_mod, materialize, slices
from marketlens.llm.textvec import LOWER, U, Words

FOLDS, HELD_OUT = 4, 2
TRAIN_DOCS, SAMPLE_BYTES = 500, 40_000_000
#: Languages whose trigram sums are held at a time.
LANG_BLOCK = 8
#: Rows of the weight table for affixes and trigrams, words per lexicon.
TABLE, LEXICON = 1 << 16, 2000
#: Training: sequences of so many words, words per segment, sequences a step, steps.
SEQUENCE, SEGMENT, BATCH, STEPS = 60, (3, 30), 96, 250


def code(*parts: np.ndarray) -> np.ndarray:
    """A row of the weight table for a tuple of small numbers."""
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(TABLE - 1)).astype(np.int32)


class Features:
    """Feature rows of all words of a batch."""

    def __init__(self, words: Words, lexicon: tuple[np.ndarray, np.ndarray]):
        data, start, end = words.data, words.start, words.end
        size = end - start
        self.affixes = []
        for kind, n in ((k, n) for k in (1, 2) for n in (1, 2, 3)):
            columns = [np.full(len(start), kind * 16 + n)]
            for i in range(n):
                at = start + i if kind == 1 else end - 1 - i
                columns.append(np.where(i < size, data[np.clip(at, 0, max(0, len(data) - 1))] if len(data) else 0, 0))
            self.affixes.append(code(*columns))
        self.start, self.end = start, end
        self.trigram = code(data[:-2], data[1:-1], data[2:]) if len(data) > 2 else np.zeros(0, np.int32)
        known, of = lexicon
        self.lexicon = np.full(len(start), -1)
        if len(known):
            h = words.hash
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            self.lexicon = np.where(known[at] == h, of[at], -1)
        #: words with an ASCII letter or any character beyond ASCII
        letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
        total = np.concatenate(([0], np.cumsum(letter)))
        self.letters = (total[end] - total[start]) > 0

    def emission(self, weights: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """Words x languages: summed weights of all features."""
        out = np.zeros((len(self.start), weights.shape[1]))
        for rows in self.affixes:
            out += weights[rows]
        last = np.minimum(np.maximum(self.start, self.end - 2), len(self.trigram))
        start = np.minimum(self.start, len(self.trigram))
        for j in range(0, weights.shape[1], LANG_BLOCK):
            block = weights[:, j : j + LANG_BLOCK]
            total = np.zeros((len(self.trigram) + 1, block.shape[1]))
            np.cumsum(block[self.trigram], axis=0, out=total[1:])
            out[:, j : j + LANG_BLOCK] += total[last] - total[start]
        has = self.lexicon >= 0
        out[has] += lex[self.lexicon[has]]
        return out

    def rows_of(self, word: int) -> np.ndarray:
        return np.concatenate(([a[word] for a in self.affixes], self.trigram[self.start[word] : max(self.start[word], self.end[word] - 2)]))


def forward_backward(e: np.ndarray, first: np.ndarray, move: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Marginals of all words.  e: words x languages; first: bounds of the texts; move: exp of
    the transition weights.  Every step handles the words at one place of all texts that
    are so long (longest texts first); messages are scaled to sum to 1.  The expected number
    of transitions between each two languages is added to ``moves`` if given."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts longer than t
    p = np.exp(e - e.max(1, keepdims=True))
    alpha = np.empty_like(p)
    for t in range(longest):
        at = begin[: live[t]] + t
        a = p[at] if t == 0 else p[at] * (a[: live[t]] @ move)
        a = a / a.sum(1, keepdims=True)
        alpha[at] = a
    beta = np.ones((len(n), p.shape[1]))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        if moves is not None and t + 1 < longest:
            a = alpha[at[: live[t + 1]]]
            z = ((a @ move) * ahead).sum(1, keepdims=True)
            moves += move * ((a / z).T @ ahead)
        m = alpha[at] * beta[:k]
        alpha[at] = m / m.sum(1, keepdims=True)
        ahead = p[at] * beta[:k]
        b = ahead @ move.T
        beta[:k] = b / b.sum(1, keepdims=True)
    return alpha


@dataclass
class Model:
    langs: list[str]
    lexicon: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray  # TABLE x languages
    lex: np.ndarray  # weight of being in a lexicon, by language
    move: np.ndarray  # exp of the transition weights

    def label(self, texts: pa.Array) -> tuple[list, list, list]:
        """Per text: language, score, and runs (lang, start, n) of words of one language."""
        words = Words(texts, LOWER)
        raw = texts.to_pylist()
        n_texts, k = len(raw), len(self.langs)
        lang, score, runs = ["und"] * n_texts, [0.0] * n_texts, [[] for _ in range(n_texts)]
        if not k or not len(words.start):
            return lang, score, runs
        f = Features(words, self.lexicon)
        g = forward_backward(f.emission(self.weights, self.lex), words.first, self.move)
        row = np.repeat(np.arange(n_texts), np.diff(words.first))
        weight = f.letters.astype(float)
        count = np.bincount(row, weights=weight, minlength=n_texts)
        mean = np.column_stack([np.bincount(row, weights=weight * g[:, j], minlength=n_texts) for j in range(k)]) / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        ascii_letters = np.bincount(row, weights=f.letters & self._plain(words), minlength=n_texts)
        top = g.argmax(1)
        new = np.ones(len(top), bool)
        new[1:] = (top[1:] != top[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(top)))
        for i in range(n_texts):
            if count[i] and (ascii_letters[i] or any(map(str.isalpha, raw[i]))):
                lang[i], score[i] = self.langs[best[i]], float(min(1.0, mean[i, best[i]]))
        for h, size in zip(heads.tolist(), sizes.tolist()):
            i = row[h]
            if lang[i] != "und":
                runs[i].append({"lang": self.langs[top[h]], "start": int(h - words.first[i]), "n": size})
        return lang, score, runs

    @staticmethod
    def _plain(words: Words) -> np.ndarray:
        """Words with an ASCII letter."""
        letter = (words.data >= 0x61) & (words.data <= 0x7A)
        total = np.concatenate(([0], np.cumsum(letter)))
        return (total[words.end] - total[words.start]) > 0


def training_rows(docs: DataFrame, per_lang: int = TRAIN_DOCS, sample_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, lang) of about ``per_lang`` texts of each language outside the held-out fold."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"))
    rows = rows.where((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("lowest"))
    share = counts.select("lang", "lowest", F.least(F.lit(per_lang) / F.col("c"), F.lit(1.0)).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where((F.col("place") < F.col("share") * 1_000_000) | (F.col("place") == F.col("lowest")))
    # of a language's picked texts, whole ones until its bytes are used; the first in any case
    picked = picked.withColumn("size", F.octet_length("text"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "size", F.xxhash64("text"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    langs = counts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("langs"))
    picked = picked.withColumns({"nth": F.row_number().over(order), "before": before}).crossJoin(F.broadcast(langs))
    budget = F.lit(SAMPLE_BYTES if sample_bytes is None else sample_bytes) / F.col("langs")
    return picked.where((F.col("nth") == 1) | ((F.col("nth") <= 2 * per_lang) & (F.col("before") + F.col("size") <= budget))).select("doc_id", "text", "lang")


def learn_lexicon(words: Words, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that one language has nearly to itself, at most LEXICON for each."""
    known, at = np.unique(words.hash, return_inverse=True)
    pair, n = np.unique(at * k + label, return_counts=True)  # of the languages a word is in
    word, lang = pair // k, pair % k
    total = np.bincount(word, weights=n, minlength=len(known))
    order = np.lexsort((lang, -n, word))
    top = order[np.searchsorted(word, np.arange(len(known)))]
    best = lang[top]
    own = (n[top] >= 0.9 * total) & (total >= 3)
    keep = []
    for j in range(k):
        mine = np.flatnonzero(own & (best == j))
        keep.append(mine[np.argsort(-total[mine], kind="stable")[:LEXICON]])
    keep = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
    return known[keep], best[keep]


def train(docs: DataFrame) -> Model:
    sample = materialize(training_rows(docs), "crf-sample").orderBy("doc_id", "lang", "text").toArrow()
    langs = sorted(set(sample.column("lang").to_pylist()))
    k = len(langs)
    words = Words(pa.array(sample.column("text").to_pylist(), pa.string()), LOWER)
    if not k or not len(words.start):
        return Model([], (np.zeros(0, U), np.zeros(0, np.int64)), np.zeros((TABLE, 1), np.float32), np.zeros((1, 1)), np.ones((1, 1)))
    index = {lang: j for j, lang in enumerate(langs)}
    label = np.repeat(np.array([index[x] for x in sample.column("lang").to_pylist()], np.int64), np.diff(words.first))
    lexicon = learn_lexicon(words, label, k)
    f = Features(words, lexicon)
    weights = np.zeros(TABLE * k)
    for rows in f.affixes:  # start from each feature's smoothed log-odds, scaled down
        cell, n = np.unique(rows.astype(np.int64) * k + label, return_counts=True)
        weights[cell] += n
    weights = weights.reshape(TABLE, k)
    share = weights.sum(0) / max(1, weights.sum())
    weights = 0.2 * (np.log(weights + share) - np.log(weights.sum(1, keepdims=True) + 1) - np.log(share))
    lex, move = np.eye(k) * 1.0, np.eye(k) * 1.0
    rng = np.random.default_rng(7)
    by_lang = [np.flatnonzero(label == j) for j in range(k)]
    grad_w, grad_l, grad_m = (np.full(x.shape, 1e-2) for x in (weights, lex, move))

    def sequence() -> np.ndarray:
        """Words of a sequence that goes from one language's text to another's."""
        out: list[np.ndarray] = []
        n = 0
        while n < SEQUENCE:
            mine = by_lang[rng.integers(k)]
            size = int(rng.integers(*SEGMENT))
            a = int(rng.integers(max(1, len(mine) - size)))
            out.append(mine[a : a + size])
            n += len(out[-1])
        return np.concatenate(out)[:SEQUENCE]

    for _ in range(STEPS):
        seq = [sequence() for _ in range(BATCH)]
        at = np.concatenate(seq)
        first = np.arange(BATCH + 1) * SEQUENCE
        y = label[at]
        rows = [f.rows_of(w) for w in at.tolist()]
        owner = np.repeat(np.arange(len(at)), [len(r) for r in rows])
        flat = np.concatenate(rows)
        e = np.zeros((len(at), k))
        for j in range(k):
            e[:, j] = np.bincount(owner, weights=weights[flat, j], minlength=len(at))
        has = f.lexicon[at] >= 0
        e[has] += lex[f.lexicon[at][has]]
        expected = np.zeros((k, k))
        g = forward_backward(e, first, np.exp(move), expected)
        miss = -g
        miss[np.arange(len(at)), y] += 1
        inner = np.setdiff1d(np.arange(len(at)), first[1:] - 1)
        m = -expected
        np.add.at(m, (y[inner], y[inner + 1]), 1)
        seen_rows, cell = np.unique(flat, return_inverse=True)
        w = np.column_stack([np.bincount(cell, weights=miss[owner, j]) for j in range(k)])
        v = np.zeros((k, k))
        np.add.at(v, f.lexicon[at][has], miss[has])
        grad_w[seen_rows] += w**2
        weights[seen_rows] += 0.1 * w / np.sqrt(grad_w[seen_rows])
        for param, grad, seen, rate in ((lex, v, grad_l, 0.1), (move, m / 20, grad_m, 0.1)):
            seen += grad**2
            param += rate * grad / np.sqrt(seen)
    return Model(langs, lexicon, weights.astype(np.float32), lex, np.exp(move))


SCHEMA = "doc_id long, lang_pred string, score double, runs array<struct<lang:string,start:int,n:int>>"
RUNS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("n", pa.int32())]))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, lang_pred, score and runs of words of one language."""
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    limit = 4 * SLICE_BYTES * 4 // max(4, len(model.langs))  # marginals have a column per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # forward-backward steps through all texts of a slice at once: fewer, larger slices
            for part in slices(batch, limit=limit):
                lang, score, runs = sent.value.label(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(runs, RUNS)], ["doc_id", "lang_pred", "score", "runs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred, score and the number of language runs."""
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return identify(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("runs").cast("long").alias("n_runs"))
