"""Operator 4: byte-pair encoding and decoding with a segment tree over pair ranks.

A piece of text is a row of symbols.  The leaves of a segment tree hold, for each
adjacent pair, its merge rank (or "none"); an inner node holds the lower of its
children, the left one on ties, so the root is the leftmost pair of lowest rank.  A
merge changes three leaves at most (the pair itself and its neighbours), each
repaired on one path to the root: O(log n) per merge, until the root says "none".

New pieces are merged many at a time: trees of equal size form one numpy matrix and
every round does one merge in each tree.  Pieces of more than ``_WIDE`` symbols use
the same tree alone (``merge_one``).  Finished pieces are kept in a bounded cache.

Defined results: null or empty text has no tokens; the bytes of special tokens found
in a text become their ids; symbols that the vocabulary lacks give no token; rows are
encoded one by one, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketlens.llm.common import slices, text_rows

_NONE = np.iinfo(np.int64).max
_WIDE = 256
_CACHE_PIECES = 150_000
_SPACES = b" \t\n\r\x0b\x0c"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where
    it is printable Latin-1, otherwise the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary (tokenizers' JSON file) with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in symbols], np.int64)
        self.size = max(self.token) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        nested = [n["pattern"]["Regex"] for n in spec["pre_tokenizer"]["pretokenizers"] if n["type"] == "Split"]
        self.split = regex.compile(nested[0])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[bytes, bytes] = {}

    # -- pieces ---------------------------------------------------------------
    def pieces(self, chunk: str) -> Iterator[bytes | int]:
        """Pre-tokens of a chunk without ASCII white space; a special token comes as its id."""
        for part in self.cut.split(chunk) if self.cut and "<|" in chunk else (chunk,):
            if part in self.special:
                yield self.special[part]
            elif part.isascii():
                yield from (p.encode() for p in self.split.findall(part.lower()))
            else:
                # character by character: a final sigma has no form of its own here
                part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                yield from (p.encode() for p in self.split.findall(part))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbol ids, ``_NONE`` where there is no merge."""
        if not len(self.key):
            return np.full(np.shape(left), _NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NONE)

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all pieces end to end, and how many each piece has."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        known = np.concatenate(([0], np.cumsum(ids >= 0)))[np.concatenate(([0], ends))]
        return ids[ids >= 0], np.diff(known)

    # -- merging --------------------------------------------------------------
    def merge_many(self, flat: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows (at most ``width`` symbols each, width a power of two), a merge a round in each."""
        n = len(length)
        sym = np.full((n, width), -1, np.int64)
        sym[np.arange(width) < length[:, None]] = flat
        after = np.tile(np.arange(1, width + 1), (n, 1))  # next live symbol
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        # leaf of a pair = rank * width + place, so that the minimum is the leftmost lowest rank
        leaf = np.full((n, width), _NONE, np.int64)
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        leaf[:, :-1] = np.where(rank == _NONE, _NONE, rank * width + np.arange(width - 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = leaf
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

        def update(row, place, value):
            node = place + width
            tree[row, node] = value
            node = node >> 1
            while len(node) and node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1

        def pair(row, place, other):
            rank = self.ranks(sym[row, place], sym[row, other])
            return np.where(rank == _NONE, _NONE, rank * width + place)

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            sym[live, at] = self.made[rank]
            sym[live, gone] = -1
            follow = after[live, gone]
            after[live, at] = follow
            update(live, gone, np.full(len(live), _NONE))
            has = follow < length[live]
            before[live[has], follow[has]] = at[has]
            value = np.full(len(live), _NONE)
            value[has] = pair(live[has], at[has], follow[has])
            update(live, at, value)
            back = before[live, at]
            has = back >= 0
            update(live[has], back[has], pair(live[has], back[has], at[has]))
            live = live[tree[live, 1] != _NONE]
        return sym[sym >= 0], (sym >= 0).sum(1)

    def merge_one(self, row: np.ndarray) -> np.ndarray:
        """The same tree for a single long piece."""
        n = len(row)
        width = 1 << (n - 1).bit_length() if n > 1 else 1
        sym, after, before = row.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks(row[:-1], row[1:])
        none = int(_NONE)
        tree = [none] * width + np.where(rank == _NONE, _NONE, rank * width + np.arange(n - 1)).tolist()
        tree += [none] * (2 * width - len(tree))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        rank_of = dict(zip(self.key.tolist(), self.rank.tolist()))

        def update(place, value):
            node = place + width
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        def pair(a, b):
            r = rank_of.get(sym[a] * self.size + sym[b])
            return none if r is None else r * width + a

        while n > 1 and (root := tree[1]) != none:
            at = root % width
            gone = after[at]
            sym[at], sym[gone] = int(self.made[root // width]), -1
            follow = after[at] = after[gone]
            update(gone, none)
            if follow < n:
                before[follow] = at
            update(at, pair(at, follow) if follow < n else none)
            if before[at] >= 0:
                update(before[at], pair(before[at], at))
        return np.array([s for s in sym if s >= 0], np.int64)

    # -- texts ----------------------------------------------------------------
    def learn(self, chunks: set[bytes]) -> None:
        """Encode chunks and put their ids (little-endian unsigned 32-bit) into the cache."""
        # a chunk of ASCII letters is one piece
        whole = {c: c.lower() for c in chunks if c.isalpha()}
        split = {c: list(self.pieces(c.decode("utf-8", "replace"))) for c in chunks if c not in whole}
        todo = set(whole.values()).union(*([p for p in parts if isinstance(p, bytes)] for parts in split.values()))
        by_width: dict[int, list[bytes]] = {}
        for p in todo:
            by_width.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(p)
        done: dict[bytes, bytes] = {}
        for width, some in by_width.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                flat, length = self.symbols(part)
                if width > _WIDE:
                    rows = [self.merge_one(r) for r in np.split(flat, np.cumsum(length)[:-1])]
                    flat, length = np.concatenate(rows), np.array([len(r) for r in rows])
                else:
                    flat, length = self.merge_many(flat, length, width)
                ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(length)).tolist()
                done.update(zip(part, (ids[a:b] for a, b in zip([0, *ends], ends))))
        self.cache.update((c, done[p]) for c, p in whole.items())
        for c, parts in split.items():
            self.cache[c] = b"".join([done[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in parts])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = set().union(*split)
        if len(self.cache) + len(new) > _CACHE_PIECES:
            self.cache = {c: self.cache[c] for c in new if c in self.cache}
        self.learn(new - self.cache.keys())
        return [b"".join([self.cache[c] for c in chunks]) for chunks in split]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space, as this vocabulary (which names no decoder) defines it."""
        return " ".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): each text's token ids as little-endian unsigned 32-bit integers.

    ``path`` is a vocabulary file that every executor has (an installed package's file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch):
                texts = [t.encode() if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tool.encode(texts), pa.binary())], ["doc_id", "ids"])
        tool.cache.clear()  # the worker may go on with other work

    return text_rows(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its ``ids`` column replaced by ``decoded``, the text of the ids."""
    kept = [c for c in encoded.columns if c != "ids"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                decoded = [tool.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(decoded, pa.string())], [*kept, "decoded"])

    return encoded.select(*kept, "ids").mapInArrow(run, ", ".join([*fields, "decoded string"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (encoded, then decoded again).

    Both ways in one pass, so that a task needs one Python worker with one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = tool.encode([t.encode() if t else b"" for t in part.column("text").to_pylist()])
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tool.cache.clear()

    return text_rows(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
