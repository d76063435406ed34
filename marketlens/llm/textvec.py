"""Vectorised words, hashes and sliding windows over a batch of texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd
_BASE2 = 0xD1B54A32D192ED03  # odd
_MASK = (1 << 64) - 1
_CHUNK = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Word bytes are kept, 0 separates: words are runs without ASCII white space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0] = 0xFF  # a NUL is a word byte, too; 0xFF does not occur in UTF-8
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
#: The same with A-Z lower-cased.
LOWER = PLAIN.copy()
LOWER[0x41:0x5B] += 0x20
#: Only digits, letters (lower-cased) and bytes of non-ASCII characters are word bytes.
ALNUM = LOWER.copy()
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64, at least n of each (kept per process)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, U)
            out[0] = 1
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U(pow(b, done, 1 << 64))
                done *= 2
            both.append(out)
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column end to end, and each text's bounds (null: empty)."""
    texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.type not in (pa.string(), pa.large_string()) else texts
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    wide = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch: byte bounds, 64-bit hash, and the index of each text's first word."""

    def __init__(self, texts: pa.Array, classes: np.ndarray = PLAIN):
        self.raw, self.offsets = buffers(texts)
        data = classes[self.raw]
        inside = data != 0
        # an edge at every change of class and at every text's start
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[heads[heads > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.data = data
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending spans, in bounded pieces."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _CHUNK)))
        a, b = int(start[i]), int(end[i:j].max())
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, U)
        np.cumsum((data[a:b].astype(U) + U(1)) * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(_BASE2))
        i = j
    return out


class Runs:
    """Hashes of runs of symbols, from one running total over all of them."""

    def __init__(self, x: np.ndarray, base: int = _BASE):
        up, self.down = powers(len(x) + 1, base)
        self.total = np.zeros(len(x) + 1, U)
        np.cumsum(x * up[: len(x)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of x[start:end] for any spans."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U) * U(_BASE2))

    def grams(self, n: int) -> np.ndarray:
        """Hash of every n consecutive symbols (across text bounds too; callers mask those)."""
        m = max(0, len(self.total) - n)
        h = self.total[n:] - self.total[:m]
        h *= self.down[:m]
        h += U((n * _BASE2) & _MASK)
        return mix(h)


def run_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Runs(x).hash(start, end)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    return Runs(x).grams(n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
