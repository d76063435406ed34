"""Windows of fixed width cut into blocks by their smallest gram.

Every window of ``width`` symbols has a key: the hash of its leftmost smallest gram of
``k`` symbols.  Consecutive windows with the same gram *position* form a block (at most
``width - k + 1`` windows, ``2 * width - k`` symbols).  Equal windows have equal keys, so
whatever decides about equal windows only has to bring together blocks with one key, and
a whole block stands for all its windows when it occurs again as it is.  No window occurs
twice inside one block.
"""

from __future__ import annotations

import numpy as np

from marketlens.llm.textvec import Runs, U, sliding_min


def window_blocks(runs: Runs, bounds: np.ndarray, width: int, k: int) -> dict[str, np.ndarray]:
    """Blocks of the texts, the symbols bounds[i] to bounds[i+1] of ``runs``: row, start (symbols from the text's
    start), n (windows), gram (place of the key's gram), key and hash (of all symbols of the
    block), in text order."""
    n_windows = len(runs.total) - width
    if n_windows <= 0:
        empty = np.zeros(0, np.int64)
        return {"row": empty, "start": empty, "n": empty, "gram": empty, "key": np.zeros(0, U), "hash": np.zeros(0, U)}
    g = runs.grams(k)
    bits = U(max(20, len(g).bit_length()))
    low = U((1 << int(bits)) - 1)
    packed = g & ~low
    packed |= np.arange(len(g), dtype=U)
    least = sliding_min(packed, width - k + 1)
    # a window has room if no text ends inside it
    room = np.zeros(n_windows + 1, np.int32)
    sizes = np.diff(bounds)
    fits = sizes >= width
    room[bounds[:-1][fits]] += 1
    room[bounds[:-1][fits] + sizes[fits] - width + 1] -= 1
    room = np.cumsum(room[:-1], dtype=np.int32) > 0
    new = np.ones(n_windows, bool)
    new[1:] = (least[1:] != least[:-1]) | (room[1:] != room[:-1])
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], n_windows)
    keep = room[edges]
    start, n = edges[keep], (ends - edges)[keep]
    row = np.searchsorted(bounds, start, side="right") - 1
    gram = (least[start] & low).astype(np.int64)
    return {"row": row, "start": start - bounds[row], "n": n, "gram": gram - bounds[row], "key": g[gram], "hash": runs.hash(start, start + n - 1 + width)}
