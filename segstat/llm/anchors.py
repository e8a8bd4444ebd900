"""Content-defined anchors: places that equal stretches of bytes have in common."""
from __future__ import annotations

import numpy as np

from .bytescan import U, Scan

GRAM = 24


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(back[:n - width + 1], ahead[width - 1:])


def anchors(s: Scan, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, gram hash, first and last window start of every anchor.

    The anchor of a window of ``length`` bytes is its leftmost gram of smallest hash, so equal
    windows have their anchors at equal offsets. Windows never cross texts.
    """
    n = len(s.data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    places = np.arange(n - gram + 1)
    hashes = s.hashes(places, places + gram)
    ranked = (hashes & U(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    chosen = (window_minimum(ranked, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(n - length + 1, bool)
    for e in s.ends.tolist():          # windows that reach into the next text
        inside[max(0, e - length + 1):e] = False
    starts = np.flatnonzero(inside)
    chosen = chosen[starts]
    first = np.ones(len(chosen), bool)
    first[1:] = chosen[1:] != chosen[:-1]
    last = np.ones(len(chosen), bool)
    last[:-1] = first[1:]
    at = chosen[first]
    return at, hashes[at], starts[first], starts[last]
