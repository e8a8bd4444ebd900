"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

A document is its token ids and one end id. Only documents longer than a sequence are cut. Pieces
as long as a sequence stand alone; the others are dealt by a hash into shards of bounded size, and
each shard is packed by several islands. A chromosome is a list of bins. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that now hold a document twice and
best-fits the documents so displaced; mutation dissolves the emptiest bins. After each epoch the
best packing of an island moves to the next island of its shard. Bins that stay below ``CLOSE``
are dissolved and meet those of other shards in the next round, so a shard boundary costs no space.

Defined cases: a missing or empty text is its end id alone (one piece of length 1); rows are told
apart by their place in the written piece table, so repeated, equal or missing ids are packed once
for each row; an empty table gives no rows.
"""
from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import map_texts, materialize, parts

LENGTH = 4096
END_ID = 1
SHARD_PIECES = 4096
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 4, 2, 6
CLOSE = 0.995          # bins filled less are offered to the next round
ROUNDS = 4

COLUMNS = ("piece", "start", "length", "ids_crc32", "uid", "sequence_id", "offset")      # these replace kept ones

_SPLIT = re.compile(r"[ \t\n\r]+")
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
# The tokenizer's own cuts, for lower-cased Latin-1 text without apostrophes: letters, single digits, anything else.
_CUTS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_DIGITS}]+")
_PROSE = re.compile(f"[{_LETTERS} \\n.,]*")
_CACHE_WORDS = 900_000
_tokenizers: dict[str, tuple] = {}


class _Known(dict):
    """Ids of words met so far; those of the texts at hand that found no room are in ``rest``."""
    rest: dict = {}

    def __missing__(self, word: str) -> bytes:
        return self.rest[word]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers.

    The tokenizer never joins across its cuts, so words are encoded once and looked up.
    """
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _tokenizers[path] = Tokenizer.from_file(path), _Known()
    tokenizer, known = _tokenizers[path]
    split = [_cut_words(t) for t in texts]
    new = list(set(filterfalse(known.__contains__, chain.from_iterable(split))))
    encoded = tokenizer.encode_batch_fast(new, add_special_tokens=False)
    ids = {w: array("I", e.ids).tobytes() for w, e in zip(new, encoded)}
    # Frequent words come early and stay; when the table is full, rare ones are encoded where they stand.
    if len(known) + len(ids) <= _CACHE_WORDS:
        known.update(ids)
    else:
        known.rest = ids
    return [b"".join(map(known.__getitem__, words)) for words in split]


def _cut_words(text: str) -> list[str]:
    """Pieces that the tokenizer encodes independently of each other."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT.split(text)
    if "'" in text or "<|" in text:
        return _SPLIT.split(text)
    text = text.lower()
    # Plain prose, where only single full stops and commas stand between words, is cut by white space.
    if _PROSE.fullmatch(text) and not any(pair in text for pair in ("..", ".,", ",.", ",,")):
        return text.replace(".", " . ").replace(",", " , ").split()
    return _CUTS.findall(text)


def pieces(docs: DataFrame, keep: list[str], path: str, text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: kept columns, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(texts: pa.Array) -> list:
        cut = [_cut(ids + end, length) for ids in token_bytes(texts.to_pylist(), path)]
        return [[a for a, _ in cut], [b for _, b in cut]]

    fields = [T.StructField("_lengths", T.BinaryType()), T.StructField("_crcs", T.BinaryType())]
    whole = map_texts(docs, keep, fields, run, text=text)
    # One array for each document, opened in the JVM.
    unpack = "transform(sequence(0, length({0}) div 8 - 1), i -> conv(hex(substring({0}, i * 8 + 1, 8)), 16, 10))"
    opened = whole.select(*[F.col(f"`{c}`") for c in whole.columns if not c.startswith("_")],
                          F.posexplode(F.arrays_zip(F.expr(unpack.format("_lengths")).alias("l"), F.expr(unpack.format("_crcs")).alias("c"))).alias("piece", "_p"))
    return opened.select(*[F.col(f"`{c}`") for c in opened.columns if c not in ("piece", "_p")], "piece",
                         (F.col("piece").cast("long") * length).alias("start"), F.col("_p.l").cast("long").alias("length"),
                         F.col("_p.c").cast("long").alias("ids_crc32"))


def _cut(ids: bytes, length: int) -> tuple[bytes, bytes]:
    step = 4 * length
    cuts = [ids[i:i + step] for i in range(0, len(ids), step)]
    return (np.array([len(c) // 4 for c in cuts], ">u8").tobytes(), np.array([zlib.crc32(c) for c in cuts], ">u8").tobytes())


# --- packing of one shard -------------------------------------------------------------------

class Bins:
    """Bins under construction, found by free space: best fit is the lowest set bit of a mask."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]]):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.free = [capacity - sum(map(sizes.__getitem__, b)) for b in bins]
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        for i, f in enumerate(self.free):
            self._hold(i, f)

    def _hold(self, i: int, free: int) -> None:
        self.at.setdefault(free, []).append(i)
        self.mask |= 1 << free

    def add(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = self.at[free]
            i = held.pop()
            if not held:
                self.mask &= ~(1 << free)
            self.bins[i].append(item)
            free -= size
        else:
            i, free = len(self.bins), self.capacity - size
            self.bins.append([item])
            self.free.append(0)
        self.free[i] = free
        self._hold(i, free)


def best_fit(sizes: list[int], capacity: int, bins: list[list[int]], items: list[int]) -> list[list[int]]:
    held = Bins(sizes, capacity, bins)
    for item in items:
        held.add(item)
    return held.bins


def fitness(sizes: list[int], capacity: int, bins: list[list[int]]) -> tuple:
    """Fewer bins first, then uneven filling, which leaves room that can still be used."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins)


def crossover(sizes: list[int], capacity: int, a: list[list[int]], b: list[list[int]], rng: random.Random) -> list[list[int]]:
    fills = [sum(map(sizes.__getitem__, x)) for x in b]
    well = [x for x, f in zip(b, fills) if f >= CLOSE * capacity]
    injected = rng.sample(well, max(1, len(well) // 3)) if well else [b[max(range(len(b)), key=fills.__getitem__)]]
    taken = set().union(*injected)
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced.extend(i for i in x if i not in taken)
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(sizes, capacity, kept + [list(x) for x in injected], displaced)


def mutate(sizes: list[int], capacity: int, bins: list[list[int]], rng: random.Random) -> list[list[int]]:
    order = sorted(range(len(bins)), key=lambda i: sum(map(sizes.__getitem__, bins[i])))
    drop = set(order[:3]) | {rng.randrange(len(bins)) for _ in range(max(1, len(bins) // 50))}
    items = [i for d in drop for i in bins[d]]
    rng.shuffle(items)
    items.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(sizes, capacity, [list(x) for i, x in enumerate(bins) if i not in drop], items)


def start(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    """Best fit in decreasing order of slightly disturbed sizes; without noise plain best-fit decreasing."""
    key = [s * (1 + noise * rng.random()) for s in sizes]
    return best_fit(sizes, capacity, [], sorted(range(len(sizes)), key=key.__getitem__, reverse=True))


def evolve(sizes: list[int], capacity: int, population: list, generations: int, rng: random.Random) -> list:
    """Steady-state generations; stops when the number of bins meets its lower bound."""
    bound = -(-sum(sizes) // capacity)
    rated = sorted(((fitness(sizes, capacity, p), i, p) for i, p in enumerate(population)), reverse=True)
    for g in range(generations):
        if -rated[0][0][0] <= bound:
            break
        a, b = rng.sample(rated, 2) if len(rated) > 1 else (rated[0], rated[0])
        child = mutate(sizes, capacity, crossover(sizes, capacity, a[2], b[2], rng), rng)
        rated[-1] = (fitness(sizes, capacity, child), len(population) + g, child)
        rated.sort(reverse=True)
    return [p for _, _, p in rated]


def _encode(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out.tobytes()


def _decode(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


_STATE = "shard long, island int, uids binary, sizes binary, packings array<binary>"


def _epoch(state: DataFrame, capacity: int, epoch: int, generations: int, population: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).tolist()
                rng = random.Random(f"{row['shard']}/{row['island']}/{epoch}")
                held = [_decode(p) for p in row["packings"]]
                if not held:
                    held = [start(sizes, capacity, rng, 0.0 if not row["island"] and not i else 0.02 + 0.1 * i) for i in range(population)]
                row["packings"] = [_encode(p, len(sizes)) for p in evolve(sizes, capacity, held[:population + 1], generations, rng)[:population]]
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return state.mapInArrow(run, _STATE)


def _migrate(state: DataFrame, islands: int, population: int) -> DataFrame:
    """The best packing of each island replaces the worst of the next island of the shard."""
    moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("packings")[0].alias("elite"))
    return state.join(moved, ["shard", "island"]).select(
        "shard", "island", "uids", "sizes",
        F.concat(F.slice("packings", 1, population - 1), F.array("elite")).alias("packings"))


def _round(items: DataFrame, n: int, capacity: int, number: int, shard_pieces: int) -> DataFrame:
    """(uid, sequence_id, offset, fill) of every item, packed shard by shard."""
    shards = max(1, round(n / shard_pieces))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"))
    grouped = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("x"))
    packed = "array_join(transform(x, p -> lpad(hex(p.{0}), {1}, '0')), '')"
    whole = grouped.select("shard", F.expr(f"unhex({packed.format('uid', 16)})").alias("u"), F.expr(f"unhex({packed.format('length', 8)})").alias("l"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, sizes = np.frombuffer(row["u"], ">i8").astype(np.int64), np.frombuffer(row["l"], ">i4").astype(np.int32)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": i, "uids": uids.tobytes(), "sizes": sizes.tobytes(), "packings": []} for i in range(ISLANDS)],
                    schema=pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("uids", pa.binary()), ("sizes", pa.binary()), ("packings", pa.list_(pa.binary()))]))

    count = min(parts(items.sparkSession), shards * ISLANDS)
    state = whole.mapInArrow(spread, _STATE).repartition(count, "shard", "island")
    for epoch in range(EPOCHS):
        state = materialize(_epoch(state, capacity, epoch, GENERATIONS, POPULATION), "islands")
        if epoch + 1 < EPOCHS:
            state = _migrate(state, ISLANDS, POPULATION).repartition(count, "shard", "island")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                uids = np.frombuffer(row["uids"], np.int64)
                bins = max((_decode(p) for p in row["packings"]), key=lambda b: fitness(sizes.tolist(), capacity, b))
                seq = (np.int64(number) << 56) + (np.int64(row["shard"]) << 16)
                order = np.array([i for b in bins for i in b], np.int64)
                bin_of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate([[True], np.diff(bin_of) > 0])
                offset = before - before[first][bin_of]
                fill = np.bincount(bin_of, sizes[order]).astype(np.int64)[bin_of]
                yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(seq + bin_of), pa.array(offset), pa.array(fill)],
                                                 names=["uid", "sequence_id", "offset", "fill"])

    # All islands of a shard hold the same items; the best of their packings counts.
    best = state.groupBy("shard").agg(F.min_by("uids", "island").alias("uids"), F.min_by("sizes", "island").alias("sizes"),
                                     F.flatten(F.collect_list("packings")).alias("packings"))
    return best.repartition(count, "shard").mapInArrow(settle, "uid long, sequence_id long, offset long, fill long")


def pack(cut: DataFrame, capacity: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` with sequence_id and offset; needs the columns uid (unique) and length (1 to capacity)."""
    alone = cut.where(F.col("length") == capacity).select("uid", (F.col("uid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < capacity).select("uid", "length")
    placed = [alone]
    for number in range(1, ROUNDS + 1):
        n = left.count()
        if not n:
            break
        done = materialize(_round(left, n, capacity, number, shard_pieces), "packed")
        last = number == ROUNDS or n <= shard_pieces
        full = done if last else done.where(F.col("fill") >= int(CLOSE * capacity))
        placed.append(full.select("uid", "sequence_id", "offset"))
        if last:
            break
        open_ = done.where(F.col("fill") < int(CLOSE * capacity)).select("uid")
        left = materialize(left.join(open_, "uid", "left_semi"), "left")
    total = placed[0]
    for p in placed[1:]:
        total = total.unionByName(p)
    return cut.join(total, "uid")


def pack_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", length: int = LENGTH,
                   end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Kept columns, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = pieces(docs, [c for c in keep if c not in COLUMNS], path, text, length, end_id)
    # The number is part of the written table, so it stays the same when a task is repeated later.
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(cut, length, shard_pieces).drop("uid")
