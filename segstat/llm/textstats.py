"""Counts that describe a text's form, for many texts at once."""
from __future__ import annotations

import numpy as np

from .bytescan import U, Scan, exact_ids, mix, repeated

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(s: Scan) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    Words are runs without space or \\t-\\r; characters are code points. A line counts as repeated
    when it has a word and equals an earlier line of its text. n_repeat_words counts the words
    lying in a three-word window that the text holds at least twice.
    """
    starts, ends = s.words()
    first = np.searchsorted(starts, s.starts)
    n_words = np.searchsorted(starts, s.ends) - first
    lead = (s.data & 0xC0) != 0x80
    word_chars = _count(lead & ~s.space, s)
    n_symbols = _count(_SYMBOL[s.data], s)
    owner = np.repeat(np.arange(s.n), n_words)
    hashes = s.hashes(starts, ends)
    # Three-word windows, told apart by text.
    repeats = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        whole = owner[:-2] == owner[2:]
        with np.errstate(over="ignore"):
            keys = mix(hashes[:-2] + U(3) * mix(hashes[1:-1] + U(5) * mix(hashes[2:] + owner[2:].astype(np.uint64))))
        twice = np.zeros(len(whole), bool)
        twice[whole] = repeated(keys[whole])
        # Equal windows have equal keys; where keys repeat, the words' bytes decide.
        at = np.flatnonzero(twice)
        used = np.unique(np.concatenate([at, at + 1, at + 2]))
        ids = np.zeros(len(starts), np.int64)
        ids[used] = exact_ids(s, starts[used], ends[used])
        key = owner[at]
        for k in range(3):
            key = np.unique(key * (ids.max() + 1) + ids[at + k], return_inverse=True)[1]
        twice[at] = repeated(key)
        for shift in range(3):
            repeats[shift:len(repeats) - 2 + shift] |= twice
    n_repeat = np.bincount(owner[repeats], minlength=s.n) if len(owner) else np.zeros(s.n, np.int64)
    line_starts, line_ends = s.lines()
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = s.owner(line_starts)
    with np.errstate(over="ignore"):
        line_keys = mix(s.hashes(line_starts, line_ends) + mix(line_owner.astype(np.uint64) + U(1)))
    n_lines = np.bincount(line_owner, minlength=s.n)
    at = np.flatnonzero(repeated(line_keys))
    _, where = np.unique(exact_ids(s, line_starts[at], line_ends[at]) * s.n + line_owner[at], return_index=True)
    again = np.bincount(line_owner[at], minlength=s.n) - np.bincount(line_owner[at][where], minlength=s.n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
            "n_dup_lines": again, "n_repeat_words": n_repeat,
            "n_lines": n_lines, "_hashes": hashes, "_owner": owner, "_starts": starts, "_ends": ends}


def _count(flags: np.ndarray, s: Scan) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[s.ends] - total[s.starts]
