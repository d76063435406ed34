"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items (as word ids) go into one suffix automaton.
A training text is streamed through it: after each word the automaton's state and the
length of the longest suffix of the stream that occurs in some item are known.  A match
of ``window`` words or more marks its words as hit, and so does a whole item that is
shorter than the window.  Spans of hit words that exceed a length or a share of the text
are removed or condemn the text.

Scale: the texts are read once, in place, and never shuffled; only counts come back.
Items are cut into blocks of at most ``BLOCK_WORDS`` words (an item stays whole, and one
longer item is a block), each block is one automaton and one broadcast of bounded size.
A pass over the texts takes ``GROUP_BLOCKS`` of them; a larger benchmark means more passes
(the rows are written in between) and not larger broadcasts or more memory in a task.  Words that no item has reset every automaton, so only
runs of known words are stepped through it; the others are skipped by a vectorised lookup.

Defined results: null or empty text has no words and is never contaminated; an item
without words (or null) has no window; a null item_id counts as an item of its own that
is left out of the id list; repeated item rows count once; an empty benchmark leaves all
texts alone; texts are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import free_names, materialize, slices, text_rows
from marketlens.llm.textvec import ALNUM, Words

WINDOW = 13
#: Words of items in one automaton, and automata in one pass over the texts.
BLOCK_WORDS, GROUP_BLOCKS = 100_000, 4


class Automaton:
    """Generalised suffix automaton over rows of word ids, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.window_items: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state, _ = self._walk(words)
                self.short.setdefault(state, (len(words), set()))[1].add(item)
                continue
            state = length = 0
            for w in words:
                state, length = self._step(state, length, w)
                if length >= window:
                    self.window_items.setdefault(self._window_state(state), set()).add(item)
        # the shorter whole items that are suffixes of a state's strings
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.ends[self.link[s]]
            self.ends[s] = (*above, s) if s in self.short else above

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._new(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _step(self, state: int, length: int, w: int) -> tuple[int, int]:
        while w not in self.next[state]:
            state = self.link[state]
            if state == -1:
                return 0, 0
            length = self.length[state]
        return self.next[state][w], length + 1

    def _walk(self, words: list[int]) -> tuple[int, int]:
        state = length = 0
        for w in words:
            state, length = self._step(state, length, w)
        return state, length

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end) in order, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = length = 0
        for i, w in enumerate(words):
            state, length = self._step(state, length, w)
            hit = 0
            if length >= self.window:
                hit = length
                found |= self.window_items.get(self._window_state(state), set())
            for s in self.ends[state]:
                n, items = self.short[s]
                if n <= length:
                    hit = max(hit, n)
                    found |= items
            if hit:
                start = i + 1 - hit
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


class Matcher:
    """One block of items, ready to scan batches of texts."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        known, codes = np.unique(words.hash, return_inverse=True)
        items = [(i, codes[a:b].tolist()) for i, a, b in zip(ids, words.first, words.first[1:])]
        self.known = known
        self.automaton = Automaton(items, window)
        self.least = min([window, *(len(w) for _, w in items if w)])

    def scan(self, words: Words) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """(row, hit word spans within the row, items) of the rows of a batch with a hit."""
        if not len(self.known) or not len(words.hash):
            return
        at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        inside = self.known[at] == words.hash
        # runs of known words within one text
        edge = np.ones(len(inside) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[words.first] = True
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[:-1], bounds[1:]
        keep = inside[starts] & (ends - starts >= self.least)
        rows = np.searchsorted(words.first, starts[keep], side="right") - 1
        current, spans, found = -1, [], set()
        for row, a, b in zip(rows.tolist(), starts[keep].tolist(), ends[keep].tolist()):
            some, items = self.automaton.stream(at[a:b].tolist())
            if not some:
                continue
            if row != current:
                if spans:
                    yield current, spans, found
                current, spans, found = row, [], set()
            first = int(words.first[row])
            spans += [(a + s - first, a + e - first) for s, e in some]
            found |= items
        if spans:
            yield current, spans, found


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[tuple[list, list]]:
    """The items in blocks of at most ``limit`` words, read one block at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")
    ids, texts, held = [], [], 0
    for r in rows.toLocalIterator():
        n = len((r.text or "").split()) + 1
        if ids and held + n > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += n
    if ids:
        yield ids, texts


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def with_hits(rows: DataFrame, benchmark: DataFrame, window: int, n_words: str, spans: str, items: str) -> DataFrame:
    """``rows`` and three columns: the text's words, hit spans (word positions) and the ids
    (as strings, sorted) of the items with windows in it.

    Each pass takes ``GROUP_BLOCKS`` blocks of items; between passes the rows are written."""
    empty = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    rows = rows.withColumns({n_words: F.lit(0).cast("long"), spans: empty[0], items: empty[1]})
    spark = rows.sparkSession
    blocks = item_blocks(benchmark)
    group, passes = list(islice(blocks, GROUP_BLOCKS)), 0
    while group or not passes:
        if passes:
            rows = materialize(rows, "hits")
        rows = rows.mapInArrow(one_pass([spark.sparkContext.broadcast(b) for b in group], window, n_words, spans, items), rows.schema)
        group, passes = list(islice(blocks, GROUP_BLOCKS)), passes + 1
    return rows


def one_pass(blocks: list, window: int, n_words: str, spans: str, items: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the hits of some blocks to the rows' spans and items."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                hit = [[(s["start"], s["end"]) for s in old] for old in part.column(spans).to_pylist()]
                found = [set(old) for old in part.column(items).to_pylist()]
                for n, block in enumerate(blocks):
                    for row, some, ids in matcher(f"{key}/{n}", block, window).scan(words):
                        hit[row].extend(some)
                        found[row].update(str(i) for i in ids if i is not None)
                made = {
                    n_words: pa.array(np.diff(words.first), pa.int64()),
                    spans: pa.array([[{"start": a, "end": b} for a, b in union_spans(h)] for h in hit], SPANS),
                    items: pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                }
                columns = [made.get(name, part.column(i)) for i, name in enumerate(part.schema.names)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, _h, text, n_words, n_hit, spans and items."""
    rows = with_hits(text_rows(docs), benchmark, window, "n_words", "spans", "items")
    return rows.withColumn("n_hit", hit_words("spans"))


def without_spans(scanned: DataFrame, min_span: int = WINDOW) -> DataFrame:
    """(doc_id, _h, cleaned): texts without their hit spans of ``min_span`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                cleaned = []
                for row, spans in enumerate(part.column("spans").to_pylist()):
                    at, kept, first = int(words.offsets[row]), [], int(words.first[row])
                    for s in spans:
                        if s["end"] - s["start"] >= min_span:
                            kept.append(words.raw[at : words.start[first + s["start"]]].tobytes())
                            at = int(words.end[first + s["end"] - 1])
                    kept.append(words.raw[at : words.offsets[row + 1]].tobytes())
                    cleaned.append(b"".join(kept).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_h"), pa.array(cleaned, pa.string())], ["doc_id", "_h", "cleaned"])

    return scanned.select("doc_id", "_h", "text", "spans").mapInArrow(run, "doc_id long, _h long, cleaned string")


_matchers: dict[str, Matcher] = {}


def matcher(key: str, block, window: int) -> Matcher:
    """A block's automaton, built once per Python worker (the latest few are kept)."""
    if key not in _matchers:
        if len(_matchers) >= GROUP_BLOCKS:
            _matchers.clear()
        _matchers[key] = Matcher(*block.value, window)
    return _matchers[key]


def contaminated(n_hit, n_words):
    """The contamination rule: at least one twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that the rule leaves, with all their columns, filtered where they are read."""
    n_words, spans, items = free_names(docs, "n_words", "spans", "items")
    rows = with_hits(docs, benchmark, window, n_words, spans, items)
    return rows.where(~contaminated(hit_words(spans), F.col(n_words))).select(docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated and the hit spans."""
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )
