"""Operator 10: language-model scores from Brown class bigrams.

The model learns from the documents outside one fold.  P(word | previous word) mixes the
class bigram, P(class | previous class) * P(word | class), with the word's own frequency.

1. Count every word of the training texts (one row per word and batch is moved).
2. Contexts.  For every word that occurs ``LEAST`` times or more, count what stands beside it, by type:
   the ``CONTEXT_WORDS`` most frequent words, ``CONTEXT_SHAPES`` groups of all others by their last letters, and the
   end of a text.  Counts are summed per task, then by word over all tasks, in two levels where there are many tasks.
3. Exchange clustering puts all these words into ``CLASSES`` classes.  In each pass every word
   moves to the class whose contexts make its own most likely, all words at once over all tasks; then the
   classes' contexts are summed anew.  Neither step can lower the likelihood; the passes end when no word
   moves or the likelihood gains less than ``GAIN`` of itself.  A pass reads the table of step 2, not the texts.
4. Transitions between classes are counted in one more scan.  Words below ``LEAST`` have classes by the
   shape of their last letters.  Before a word stands its class, too, if the word is among the ``HEAD`` most
   frequent ones (their classes are broadcast, a fixed number); any rarer word stands there by its shape.
5. Scores.  Tokens of frequent words are scored in their task; all rarer words meet their counts and
   classes in a join by word hash: a rare word is in few texts, so no join key is hot.

The number of clustered words, and of their contexts, grows with the corpus; the driver holds class
tables and the HEAD words.  All probabilities after one class sum to 1 over the words
of the training texts and one unseen word for each shape.

Defined results: null and empty texts are one end token; a null doc_id is neither learned
from nor held out; repeated rows count and are scored each; with no training text every
probability is 1 (the formula's value); equal likelihoods go to the lower class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import KeyBitmap, columns, crc_mod, materialize, slices, text_rows
from marketlens.llm.textvec import LOWER, U, Words, signed

#: Words that occur so often get a class from their own contexts; the number of classes; shapes of all others.
LEAST, CLASSES, SHAPES = 20, 64, 1024
#: Frequent words whose counts and classes are broadcast.
HEAD = 1 << 18
CONTEXT_WORDS, CONTEXT_SHAPES = 95, 32
#: Relative gain in likelihood below which the passes end.
GAIN = 1e-5
FOLDS, HELD_OUT = 10, 0
#: Weight of the class bigram in the mixture, the constant added to counts, and tokens that a class's
#: overall frequency counts for after each class.
CLASS_WEIGHT, ADD, PRIOR = 0.92, 0.1, 10.0
#: Stands for the end of a text among the word hashes.
END = -0x123456789ABCDEF
#: Context types on one side; the last one is the end of a text.
TYPES = CONTEXT_WORDS + CONTEXT_SHAPES + 1
#: Classes, then shapes, then the end of a text.
KINDS = CLASSES + SHAPES + 1
#: Tokens whose contexts are summed at a time, entries and words of a merged group, and tasks merged in one level.
TOKENS, ENTRIES, FAN = 1_000_000, 4_000_000, 64


def shapes(words: Words) -> np.ndarray:
    """Shape of each word, from its last three bytes."""
    last = np.zeros(len(words.start), np.int64)
    for back in (1, 2, 3):
        at = words.end - back
        last = last * 257 + np.where(at >= words.start, words.data[np.maximum(at, 0)], 0)
    return (last * 2654435761 >> 16) % SHAPES


def with_ends(words: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Token values of all texts in order, each text followed by ``end``; and each token's row."""
    n = len(words.first) - 1
    row = np.repeat(np.arange(n), np.diff(words.first))
    out = np.empty(len(values) + n, values.dtype)
    rows = np.empty(len(values) + n, np.int64)
    at = np.arange(len(values)) + row
    ends = words.first[1:] + np.arange(n)
    out[at], out[ends] = values, end
    rows[at], rows[ends] = row, np.arange(n)
    return out, rows


def shifted(values: np.ndarray, first) -> np.ndarray:
    """What stands before each token; before a text stands an end, as after the text before it."""
    return np.concatenate(([first], values[:-1]))


def training(docs: DataFrame) -> DataFrame:
    fold = crc_mod("doc_id", FOLDS)
    return docs.where(fold != HELD_OUT)


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, shape, c): how often each training word occurs; the end of a text is a word, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"), LOWER)
            w, at, c = np.unique(words.hash, return_index=True, return_counts=True)
            shape = shapes(words)[at]
            w, shape, c = np.append(signed(w), END), np.append(shape, -1), np.append(c, len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(shape.astype(np.int32)), pa.array(c.astype(np.int64))], ["w", "shape", "c"])

    rows = training(text_rows(docs)).select("text").mapInArrow(run, "w long, shape int, c long")
    return rows.groupBy("w").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


class Lookup:
    """Word hash -> place in a fixed list of words (or -1)."""

    def __init__(self, w: np.ndarray):
        self.order = np.argsort(w)
        self.sorted = w[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def frequent(words: DataFrame, limit: int | None = None) -> DataFrame:
    """The words above a frequency that at most ``limit`` (HEAD) words exceed.

    The frequency comes from a histogram of logarithms (a few hundred rows), so that no
    task has to merge the most frequent words of all others.
    """
    size = F.floor(F.log2("c") * 32)
    bins = columns(words.groupBy(size.alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")))
    fits = bins["bin"][np.cumsum(bins["k"]) <= (HEAD if limit is None else limit)]
    return words.where(size >= int(fits.min())) if len(fits) else words.limit(0)


# ------------------------------------------------------------------ contexts

def summed(word: np.ndarray, side: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum ``n`` (below 2^32; none: ones) by (word, side): distinct words, bounds of their entries, the
    entries' sides and sums.  Words are integers below 2^22."""
    key = word * (2 * TYPES) + side
    if n is None:
        key, total = np.unique(key, return_counts=True)
    else:  # sorted as one number with the counts
        both = np.sort(key << 32 | n)
        key = both >> 32
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(both & 0xFFFFFFFF, head) if len(key) else both
        key = key[head]
    word, side = np.divmod(key, 2 * TYPES)
    edges = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    return word[edges], np.append(edges, len(word)), side, total


def vector_rows(w: np.ndarray, bounds: np.ndarray, side: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
    """(w, part, side, n) with the entries as bytes; counts above 2^32 - 1, of contexts only, stay there."""
    side, n = side.astype(np.uint8).tobytes(), np.minimum(n, 0xFFFFFFFF).astype("<u4").tobytes()
    cut = lambda data, wide: pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer((bounds * wide).astype(np.int32).tobytes()), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), part, np.int32)), cut(side, 1), cut(n, 4)], ["w", "part", "side", "n"])


VECTORS = "w long, part int, side binary, n binary"


def entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, side and count of each entry."""
    side = rows.column("side").to_pylist()
    lengths = np.array([len(s) for s in side], np.int64)
    row = np.repeat(np.arange(len(side)), lengths)
    return row, np.frombuffer(b"".join(side), np.uint8).astype(np.int64), np.frombuffer(b"".join(rows.column("n").to_pylist()), "<u4").astype(np.int64)


def merge(group: pa.Table) -> pa.Table:
    """One row for each word of the group."""
    row, side, n = entries(group)
    w, place = np.unique(group.column("w").to_numpy(), return_inverse=True)
    word, bounds, side, n = summed(place[row], side, n)
    return pa.Table.from_batches([vector_rows(w[word], bounds, side, n, 0)])


def contexts(docs: DataFrame, words: DataFrame, top: np.ndarray) -> DataFrame:
    """(w, side, n) of the words that are to be clustered; ``top``: the most frequent words."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((Lookup(top[:CONTEXT_WORDS]), KeyBitmap(words.where(F.col("c") >= LEAST), "w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types, wanted = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, before, after = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
            held.clear()
            w = np.unique(h)
            place = np.searchsorted(w, h)
            word, bounds, side, n = summed(np.concatenate((place, place)), np.concatenate((before, after + TYPES)))
            return vector_rows(w[word], bounds, side, n, part)

        for batch in batches:
            for piece in slices(batch):
                tokens = Words(piece.column("text"), LOWER)
                h = signed(tokens.hash)
                place = types(h)
                kind, _ = with_ends(tokens, np.where(place >= 0, place, CONTEXT_WORDS + shapes(tokens) % CONTEXT_SHAPES), TYPES - 1)
                seq, _ = with_ends(tokens, h, END)
                mine = np.flatnonzero(wanted.has(seq.view(U)) & (seq != END))
                before, after = shifted(kind, TYPES - 1)[mine], np.append(kind[1:], TYPES - 1)[mine]
                held.append((seq[mine], before, after))
                if sum(len(x[0]) for x in held) >= TOKENS:
                    yield flush()
        if held:
            yield flush()

    rows = materialize(training(text_rows(docs)).select("text").mapInArrow(run, VECTORS), "brown-contexts")
    size, parts = rows.agg(F.coalesce(F.sum(F.length("side")), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    bucket = F.pmod("w", F.lit(max(1, -(-size // ENTRIES)))).alias("bucket")
    if parts > FAN:  # a frequent word has a row from every task: groups of tasks first
        rows = rows.groupBy(bucket, F.floor(F.col("part") / FAN).alias("level")).applyInArrow(merge, VECTORS)
    return rows.groupBy(bucket).applyInArrow(merge, VECTORS).drop("part")


# ------------------------------------------------------------------ classes

def dense(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The rows' counts by side."""
    row, side, n = entries(rows)
    out = np.zeros((len(rows), 2 * TYPES), np.float32)
    out[row, side] = n
    return out


def profiles(sums: np.ndarray) -> np.ndarray:
    """Logarithms of the classes' context probabilities, left and right sides apart; a little of what all words have is mixed in."""
    out = np.empty_like(sums)
    for half in (slice(0, TYPES), slice(TYPES, 2 * TYPES)):
        everywhere = sums[:, half].sum(0) + ADD
        mixed = sums[:, half] + everywhere / everywhere.sum()
        out[:, half] = np.log(mixed / mixed.sum(1, keepdims=True))
    return out


def assign(counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest class of each row, and the logarithm of its likelihood."""
    fit = counts @ logs.astype(np.float32).T
    label = fit.argmax(1)
    return label, fit[np.arange(len(label)), label].astype(np.float64)


def exchange(vectors: DataFrame, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """Context profiles of the classes at the end of the passes, and the number of passes.  ``seeds``: a
    word's contexts for each class.  When no word moves, the classes' sums and the likelihood stay as they are."""
    sc = vectors.sparkSession.sparkContext
    logs, best, passes = profiles(seeds), -np.inf, 0
    while True:
        sent = sc.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, fit = np.zeros((len(sent.value), 2 * TYPES)), 0.0
            for batch in batches:
                counts = dense(batch)
                label, values = assign(counts, sent.value)
                member = np.zeros((len(label), len(total)))
                member[np.arange(len(label)), label] = 1
                total += member.T @ counts
                fit += values.sum()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], fit))], ["at", "n"])

        got = columns(vectors.select("side", "n").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")))
        fit = float(got["n"][got["at"] < 0].sum())
        sums = np.zeros(logs.size)
        sums[got["at"][got["at"] >= 0]] = got["n"][got["at"] >= 0]
        sent.destroy()
        passes += 1
        if fit - best <= GAIN * abs(fit):
            return logs, passes
        best, logs = fit, profiles(sums.reshape(logs.shape))


def classes(docs: DataFrame, words: DataFrame, top: np.ndarray) -> DataFrame:
    """(w, c, label): the class of every word that occurs LEAST times or more."""
    vectors = materialize(contexts(docs, words, top).join(words.where(F.col("c") >= LEAST).select("w", "c"), "w"), "brown-vectors")
    first = vectors.where(F.col("w").isin([int(w) for w in top[:CLASSES]])).toArrow().combine_chunks()
    seeds = np.zeros((CLASSES, 2 * TYPES))
    if len(first):
        order = np.lexsort((first.column("w").to_numpy(), -first.column("c").to_numpy()))
        seeds[: len(order)] = dense(first)[order]
    logs, _ = exchange(vectors, seeds)
    sent = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = assign(dense(batch), sent.value)[0] if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("c"), pa.array(label.astype(np.int32))], ["w", "c", "label"])

    return materialize(vectors.mapInArrow(run, "w long, c long, label int"), "brown-classes")


# ------------------------------------------------------------------ model

@dataclass
class Model:
    """Tables of bounded size: the head words with their counts and classes, and probabilities by class."""

    head: Lookup
    counts: np.ndarray  # of the head words
    label: np.ndarray  # of the head words: a class, or -1 for a shape
    move: np.ndarray  # P(kind | kind before)
    mass: np.ndarray  # by class: tokens of its words
    within: np.ndarray  # by shape: what its words' (c + ADD) are divided by
    n: float
    v: float
    end_count: float = 0.0

    @property
    def total(self) -> float:
        return self.n + ADD * (self.v + 1)

    @property
    def weight(self) -> float:
        return CLASS_WEIGHT if self.n else 0.0

    def kinds(self, place: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class or shape of words by their place among the head words."""
        label = self.label[place] if len(self.label) else np.full(len(place), -1)
        return np.where((place >= 0) & (label >= 0), label, CLASSES + shape)

    def mixed(self, before: np.ndarray, shape: np.ndarray, c: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(word | kind before) of words with their count (0: unseen) and class (-1: their shape)."""
        own = label >= 0
        by_class = self.move[before, np.where(own, label, CLASSES + shape)]
        emitted = np.where(own, c / np.maximum(self.mass[np.maximum(label, 0)], 1), (c + ADD) / self.within[shape])
        plain = np.where(c > 0, c + ADD, ADD / (SHAPES if self.n else 1)) / self.total
        return self.weight * by_class * emitted + (1 - self.weight) * plain

    def parts(self, texts: pa.Array) -> dict[str, object]:
        """Per text: tokens, known head tokens, both scores without the words beyond the head, and those
        words with the kind before them and their shape."""
        words = Words(texts, LOWER)
        h, shape = signed(words.hash), shapes(words)
        place = self.head(h)
        seq, row = with_ends(words, self.kinds(place, shape), KINDS - 1)
        before = shifted(seq, KINDS - 1)
        c = np.where(place >= 0, self.counts[place] if len(self.counts) else 0.0, 0.0)
        label = np.where(place >= 0, self.label[place] if len(self.label) else -1, -1)
        ends = seq == KINDS - 1
        score, base, known = np.zeros(len(seq)), np.zeros(len(seq)), np.zeros(len(seq))
        at = np.flatnonzero(~ends)
        here = place >= 0
        score[at[here]] = np.log10(self.mixed(before[at[here]], shape[here], c[here], label[here]))
        base[at[here]] = np.log10((c[here] + ADD) / self.total)
        known[at[here]] = c[here] > 0
        end = (self.end_count + ADD) / self.total
        score[ends] = np.log10(self.weight * self.move[before[ends], KINDS - 1] + (1 - self.weight) * end)
        base[ends], known[ends] = np.log10(end), self.end_count > 0
        n = len(texts)
        sums = [np.bincount(row, weights=x, minlength=n) for x in (np.ones(len(row)), known, score, base)]
        bounds = np.concatenate(([0], np.cumsum(~here)))[words.first]
        rare = pa.StructArray.from_arrays([pa.array(h[~here]), pa.array(before[at[~here]].astype(np.int32)), pa.array(shape[~here].astype(np.int32))], ["w", "before", "shape"])
        return {"n_tokens": sums[0], "n_known": sums[1], "score": sums[2], "base": sums[3], "rare": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rare)}


def transitions(docs: DataFrame, model: Model, labels: DataFrame) -> np.ndarray:
    """Counts of neighbouring kinds in the training texts (a text is preceded by an end)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, KeyBitmap(labels, "w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        total = np.zeros(KINDS * KINDS, np.int64)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), LOWER)
                h, shape = signed(words.hash), shapes(words)
                place = known.head(h)
                seq, _ = with_ends(words, known.kinds(place, shape), KINDS - 1)
                later, _ = with_ends(words, (place < 0) & wanted.has(h.view(U)), False)  # classes that only the join knows
                hash_, _ = with_ends(words, h, END)
                before = shifted(seq, KINDS - 1)
                which, n = np.unique(before[~later] * KINDS + seq[~later], return_counts=True)
                total[which] += n
                open_ = np.flatnonzero(later)
                if len(open_):
                    columns_ = [hash_[open_], before[open_] * KINDS + seq[open_], np.ones(len(open_), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_], ["w", "pair", "n"])
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(which), pa.int64()), pa.array(which), pa.array(total[which])], ["w", "pair", "n"])

    rows = training(text_rows(docs)).select("text").mapInArrow(run, "w long, pair long, n long").groupBy("w", "pair").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "brown-transitions")
    later = rows.where("w is not null").join(labels.select("w", "label"), "w", "left")
    pair = F.when(F.col("label").isNotNull(), F.expr(f"pair div {KINDS}") * KINDS + F.col("label")).otherwise(F.col("pair"))
    found = columns(rows.where("w is null").select("pair", "n").unionByName(later.select(pair.alias("pair"), "n")).groupBy("pair").agg(F.sum("n").alias("n")))
    out = np.zeros(KINDS * KINDS)
    out[found["pair"]] = found["n"]
    return out.reshape(KINDS, KINDS)


def train(docs: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the class of every clustered word (w, c, label)."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("w") == END, F.col("c"))), F.lit(0)).alias("e")).first()
    words = counts.where(F.col("w") != END)
    head = columns(frequent(words.select("w", "c")))
    order = np.lexsort((head["w"], -head["c"]))
    w, c = head["w"][order], head["c"][order].astype(np.float64)
    labels = classes(docs, words, w)
    known = columns(frequent(words.select("w", "c")).join(labels.select("w", "label"), "w").select("w", "label"))
    lookup = Lookup(w)
    label = np.full(len(w), -1)
    label[lookup(known["w"])] = known["label"]
    by_class = columns(labels.groupBy("label").agg(F.sum("c").alias("c")))
    mass = np.zeros(CLASSES)
    mass[by_class["label"]] = by_class["c"]
    by_shape = columns(words.where(F.col("c") < LEAST).groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")))
    size, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    size[by_shape["shape"]], kinds[by_shape["shape"]] = by_shape["c"], by_shape["v"]
    model = Model(lookup, c, label, np.zeros((1, 1)), mass, size + ADD * (kinds + 1), float(total["n"]), float(total["v"]), float(total["e"]))
    table = transitions(docs, model, labels)
    overall = np.concatenate((mass, size + ADD, [model.end_count])) + (0.0 if model.n else 1.0)
    model.move = (table + PRIOR * overall / overall.sum()) / (table.sum(1, keepdims=True) + PRIOR)
    return model, labels


def scores(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    counts = materialize(word_counts(docs), "brown-counts")
    return score(docs, counts, *train(docs, counts))


def score(docs: DataFrame, counts: DataFrame, model: Model, labels: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = sent.value.parts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p["n_tokens"].astype(np.int64)), pa.array(p["n_known"].astype(np.int64)), pa.array(p["score"]), pa.array(p["base"]), p["rare"]],
                    ["doc_id", "n_tokens", "n_known", "score", "base", "rare"],
                )

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, shape, c, label = (batch.column(k).to_numpy() for k in ("before", "shape", "c", "label"))
            c = c.astype(np.float64)
            logs = np.log10(sent.value.mixed(before, shape, c, label))
            yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(logs), pa.array(np.log10((c + ADD) / sent.value.total)), pa.array((c > 0).astype(np.int64))], ["r", "score", "base", "known"])

    schema = "doc_id long, n_tokens long, n_known long, score double, base double, rare array<struct<w:long,before:int,shape:int>>"
    rows = text_rows(docs).select("doc_id", "text").mapInArrow(run, schema)
    rows = materialize(rows.withColumn("r", F.monotonically_increasing_id()), "brown-parts")
    # words beyond the head: their counts, and classes if they have any
    beyond = counts.select("w", "c").join(labels.select("w", "label"), "w", "left")
    rare = rows.select("r", F.explode("rare").alias("t")).select("r", "t.*").join(beyond, "w", "left")
    rare = rare.select("r", "before", "shape", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("label", F.lit(-1)).alias("label"))
    sums = rare.mapInArrow(late, "r long, score double, base double, known long").groupBy("r").agg(*(F.sum(c).alias(f"late_{c}") for c in ("score", "base", "known")))
    all_ = rows.drop("rare").join(sums, "r", "left")
    plus = lambda c, d, zero: F.col(c) + F.coalesce(d, F.lit(zero))
    total = plus("score", "late_score", 0.0)
    return all_.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        plus("n_known", "late_known", 0).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        plus("base", "late_base", 0.0).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
