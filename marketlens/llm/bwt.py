"""Repeated strings of a minimum length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` symbols or more (symbols 0..256), by prefix doubling."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    for i in range(7):  # the first seven symbols as one number
        packed <<= 9
        packed[: max(0, n - i)] |= text[i:]
    order = np.argsort(packed)
    known = 7
    while True:
        new = np.ones(n, bool)
        new[1:] = packed[order[1:]] != packed[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if known >= depth or new.all():
            return order
        # sort on only where the order is still open
        open_ = ~new
        open_[:-1] |= ~new[1:]
        places = np.flatnonzero(open_)
        suffix = order[places]
        packed = rank * (n + 1)
        follow = np.zeros(len(suffix), np.int64)
        inside = suffix + known < n
        follow[inside] = rank[suffix[inside] + known]
        packed[suffix] += follow
        order[places] = suffix[np.argsort(packed[suffix])]
        known *= 2


def common_prefix_breaks(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """breaks[i]: suffixes order[i-1] and order[i] differ within their first ``limit`` symbols.

    Breadth-first backward extension: the queue holds the suffix-order intervals of strings
    of one length; putting a symbol in front (through the transform's last-to-first mapping)
    gives the intervals of length + 1.  The right end of a new interval is a place where the
    common prefix has exactly the former length, unless a shorter one was found there, and
    only intervals with a new end are extended on.  The lengths grow by one a round, so the
    rounds stop at ``limit`` with every longer common prefix still unbroken.
    """
    n = len(text)
    last = text[order - 1].astype(np.uint16)  # the transform; order 0 wraps to the final separator
    by_symbol = np.argsort(last, kind="stable")
    first = np.empty(n, np.int64)
    first[by_symbol] = np.arange(n)  # last-to-first mapping
    breaks = np.zeros(n + 1, bool)
    breaks[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(limit):
        width = high - low
        ends = np.cumsum(width)
        owner = np.repeat(np.arange(len(low)), width)
        place = np.arange(ends[-1]) + np.repeat(low - (ends - width), width)
        symbol = last[place]
        by = np.argsort(symbol, kind="stable")
        symbol, owner, place = symbol[by], owner[by], place[by]
        head = np.ones(len(by), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(head)
        low = first[place[heads]]
        high = low + np.diff(np.append(heads, len(by)))
        fresh = ~breaks[high]
        breaks[high] = True
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return breaks[:n]


def repeated_windows(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """Per block, the offsets at which a string of ``length`` bytes begins that begins
    at another place of these blocks, too."""
    sizes = np.array([len(b) + 1 for b in blocks])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join([*blocks, b""]), np.uint8)
    text = raw.astype(np.int64) + 1
    text[ends - 1] = 0  # a separator after each block
    order = sorted_suffixes(text, length)
    breaks = common_prefix_breaks(text, order, length)
    alike = ~breaks
    alike[:-1] |= ~breaks[1:]
    place = np.sort(order[alike])
    block = np.searchsorted(ends, place, side="right")
    fits = place + length <= ends[block] - 1
    place, block = place[fits], block[fits]
    cut = np.searchsorted(block, np.arange(len(blocks) + 1))
    begin = ends - sizes
    return [place[a:b] - begin[i] for i, (a, b) in enumerate(zip(cut, cut[1:]))]
