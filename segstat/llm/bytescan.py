"""Words, lines and hashes of many texts at once, as numpy arrays over their UTF-8 bytes."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)  # one random value for each byte
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that any of their bits can be used."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(20, n.bit_length())
        held = np.full(size, U(base), np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


@dataclass
class Scan:
    """Bytes of several texts in a row; text i lies in [starts[i], ends[i])."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.space = _SPACE[self.data]
        self._sums = None

    @property
    def n(self) -> int:
        return len(self.starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Which text holds each byte position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions each text holds."""
        return np.searchsorted(positions, self.ends) - np.searchsorted(positions, self.starts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs without white space, never across texts."""
        word = ~self.space
        edge = np.zeros(len(word) + 1, bool)
        edge[self.starts] = True
        edge[len(word)] = True
        first, last = word.copy(), word.copy()
        first[1:] &= self.space[:-1] | edge[1:-1]
        last[:-1] &= self.space[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines of the texts, split at line feeds."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.starts, feeds + 1])
        ends = np.concatenate([feeds, self.ends])
        order = np.argsort(starts, kind="stable")
        # An empty text starts where the next begins; its line comes first in both orders.
        return starts[order], np.sort(ends, kind="stable")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
        if self._sums is None:
            n = len(self.data)
            with np.errstate(over="ignore"):
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[self.data] * _power(_MULT, n), out=self._sums[1:])
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts])


def scan(texts: pa.Array) -> Scan:
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return Scan(data, offsets[:-1], offsets[1:])


def sums(values: np.ndarray, owner_starts: np.ndarray, owner_ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs values[start:end]; empty runs give zero."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[owner_ends] - total[owner_starts]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the ranges a[a_start:][:length] and b[b_start:][:length] hold equal bytes; eight at a time."""
    same = np.ones(len(lengths), bool)
    if not len(lengths):
        return same
    at, left = np.arange(len(lengths)), lengths
    wide_a, wide_b = (np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(8, np.uint8)]), 8) for x in (a, b))
    done = 0
    while len(at):
        x = wide_a[a_starts[at] + done].reshape(-1).view(np.uint64)
        y = wide_b[b_starts[at] + done].reshape(-1).view(np.uint64)
        short = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(short == 8, ~U(0), (U(1) << (short * U(8))) - U(1))
        differs = ((x ^ y) & mask) != 0
        same[at[differs]] = False
        more = ~differs & (left > 8)
        at, left = at[more], left[more] - 8
        done += 8
    return same


def exact_ids(s: Scan, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of byte ranges, equal just where their bytes are: the hash sorts them, the bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(s.hashes(starts, ends), return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[first[ids]]
    same[same] = same_bytes(s.data, starts[same], s.data, starts[first[ids[same]]], lengths[same])
    ids = ids.astype(np.int64)
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):              # ranges that share a hash with another one
        ids[i] = known.setdefault(s.data[starts[i]:ends[i]].tobytes(), len(first) + len(known))
    return ids
