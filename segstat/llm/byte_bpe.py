"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

Pre-tokens are cut by the vocabulary's pattern (contractions, letters, numbers, other signs, white space) for a
whole batch of texts at once, from the classes of its code points. Each is then looked up in two tiers:

1. a minimal perfect hash over the vocabulary names the one entry that a pre-token can be; equal
   bytes make that entry its id;
2. pre-tokens that are no entry are merged from their bytes: a heap holds the ranks of
   neighbouring parts, parts form a linked list, and the lowest rank, leftmost first, is merged until no
   neighbours form an entry. A worker keeps the ids of pre-tokens it has met (a bounded table).

The vocabulary is read on the driver and sent to tasks; ``MAX_VOCABULARY`` bounds its size. It must hold
all 256 single bytes. Only the pattern described here is supported.

Defined cases: missing and empty texts have no ids and decode to no bytes; special tokens are ordinary text; a
pre-token of any length costs n log n; rows are encoded one by one, so repeated rows agree; extra columns
pass through, and replaced are those named like a new column.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import bytescan
from .tables import map_texts, pieces

MAX_VOCABULARY = 64 << 20      # bytes of all entries together
_KNOWN_PIECES, _KNOWN_LENGTH = 400_000, 64
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for run in regex.finditer(pattern, every):
                first, last = ord(run[0][0]), ord(run[0][-1])
                table[first:last + 1] = kind
        _classes.append(table)
    return _classes[0]


def cuts(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; ``heads`` marks the first code point of each text."""
    n = len(codes)
    kind = classes()[codes]
    change = heads.copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = change.copy()
    first = np.flatnonzero(change)
    after = np.append(first[1:], n)
    inside = after < n
    inside[inside] = ~heads[after[inside]]
    # White space before something else leaves its last character, and a plain space goes with what follows.
    spaces = (kind[first] == _SPACE) & inside
    last = after[spaces] - 1
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    # An apostrophe alone, where a match begins, takes the letters of a contraction.
    lone = first[(kind[first] == _OTHER) & (after - first == 1) & inside]
    lone = lone[(codes[lone] == 0x27) & begin[lone]]
    one = np.isin(codes[lone + 1], [ord(c) for c in _SHORT])
    taken = lone[one] + 1
    two = lone[~one] + 1
    two = two[two + 1 < n]
    two = two[~heads[two + 1]]
    pair = codes[two].astype(np.int64) << 32 | codes[two + 1]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in _LONG])]
    begin[taken], begin[two] = False, False
    ends = np.concatenate([taken + 1, two + 2])
    begin[ends[ends < n]] = True
    return begin


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no entry itself."""
    n = len(piece)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))     # of the part that starts here; -1: merged away
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = following[i]
        if j < 0 or j >= n or following[j] != end:
            continue
        following[i], following[j] = end, -1
        left = before[i]
        if left >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heappush(heap, (rank, left, end))
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i:following[end]])) is not None:
                heappush(heap, (rank, i, following[end]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:following[i]]])
        i = following[i]
    return ids


class PerfectHash:
    """Numbers n distinct 64-bit values from 0 to n - 1: who is alone in a slot of a level stays, the others go on."""

    def __init__(self, values: np.ndarray):
        if len(np.unique(values)) != len(values):
            raise ValueError("two entries of the vocabulary have one hash")
        self.levels: list[np.ndarray] = []
        left, numbered = values, 0
        while len(left):
            slots = self._slots(left, len(self.levels), 2 * len(left))
            alone = np.bincount(slots, minlength=2 * len(left))[slots] == 1
            level = np.full(2 * len(left), -1, np.int32)
            level[slots[alone]] = np.arange(numbered, numbered + alone.sum())
            numbered += int(alone.sum())
            self.levels.append(level)
            left = left[~alone]

    @staticmethod
    def _slots(values: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (bytescan.mix(values + np.uint64(level * 0x9E3779B9)) % np.uint64(size)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The number of each value; any number or -1 where it is none of the n."""
        found = np.full(len(values), -1, np.int64)
        left = np.arange(len(values))
        for k, level in enumerate(self.levels):
            got = level[self._slots(values[left], k, len(level))]
            met = got >= 0
            found[left[met]] = got[met]
            left = left[~met]
            if not len(left):
                break
        return found


@dataclass
class Vocabulary:
    """Entries by the number that the perfect hash gives them."""
    ranks: dict[bytes, int]

    def __post_init__(self):
        if sum(map(len, self.ranks)) > MAX_VOCABULARY:
            raise ValueError("the vocabulary is too large to be sent to every task")
        if not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        entries, ids = list(self.ranks), np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        scan = bytescan.scan(pa.array(entries, pa.binary()))
        hashes = scan.hashes(scan.starts, scan.ends)
        self.hash = PerfectHash(hashes)
        order = np.argsort(self.hash.find(hashes))
        self.ids, lengths = ids[order], (scan.ends - scan.starts)[order]
        self.data = np.frombuffer(b"".join(entries[i] for i in order), np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.number_of_id = np.full(int(ids.max()) + 1, -1, np.int64)
        self.number_of_id[self.ids] = np.arange(len(ids))
        self.known: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        scan = bytescan.scan(texts)
        lead = (scan.data & 0xC0) != 0x80
        places = np.flatnonzero(lead)
        codes = np.frombuffer(scan.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(codes), bool)
        heads[np.searchsorted(places, scan.starts[scan.ends > scan.starts])] = True
        starts = places[cuts(codes, heads)] if len(codes) else places
        ends = np.append(starts[1:], len(scan.data)) if len(starts) else starts
        number = self.hash.find(scan.hashes(starts, ends))
        maybe = np.flatnonzero((number >= 0) & (self.lengths[number] == ends - starts))
        equal = bytescan.same_bytes(scan.data, starts[maybe], self.data, self.starts[number[maybe]], (ends - starts)[maybe])
        whole = np.zeros(len(starts), bool)
        whole[maybe[equal]] = True
        missed = np.flatnonzero(~whole)
        merged = self._merged(scan.data.tobytes(), starts[missed].tolist(), ends[missed].tolist())
        counts = np.ones(len(starts), np.int64)
        counts[missed] = [len(m) for m in merged]
        ids = np.empty(int(counts.sum()), np.int64)
        is_whole = np.repeat(whole, counts)
        ids[is_whole] = self.ids[number[whole]]
        ids[~is_whole] = [i for m in merged for i in m]
        upto = np.concatenate([[0], np.cumsum(counts)])
        per_text = upto[np.searchsorted(starts, scan.ends)] - upto[np.searchsorted(starts, scan.starts)]
        return ids, per_text

    def _merged(self, data: bytes, starts: list[int], ends: list[int]) -> list[list[int]]:
        known, out = self.known, []
        for a, b in zip(starts, ends):
            piece = data[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece, self.ranks)
                if len(known) < _KNOWN_PIECES and b - a <= _KNOWN_LENGTH:     # frequent pre-tokens come early and stay
                    known[piece] = ids
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the number of bytes up to each id."""
        number = self.number_of_id[ids] if not len(ids) or 0 <= ids.min() and ids.max() < len(self.number_of_id) else np.array([-1])
        if (number < 0).any():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[number]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.data[bytescan.ragged(self.starts[number], lengths)], upto


def load(path: str) -> Vocabulary:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def _sent(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Kept columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every text."""
    sent = _sent(docs, path)

    def run(texts: pa.Array) -> list:
        ids, counts = sent.value.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
        return [pa.array(counts), made.cast(pa.binary())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return map_texts(docs, docs.columns if keep is None else keep, fields, run, text=text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for; missing ids give none."""
    sent = _sent(encoded, path)
    others = [c for c in encoded.columns if c != to]
    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_kept"), F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("_ids"))
    schema = T.StructType([T.StructField("_kept", packed.schema["_kept"].dataType), T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_ids", 1 << 20):
            scan = bytescan.scan(batch.column(1))
            data, upto = sent.value.decode(np.frombuffer(scan.data.tobytes(), "<u4").astype(np.int64))
            offsets = upto[np.append(scan.starts, scan.ends[-1]) // 4]
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), made.cast(pa.binary())], schema=pa.schema([pa.field("_kept", batch.column(0).type), pa.field(to, pa.binary())]))

    return packed.mapInArrow(run, schema).select("_kept.*", to)
