"""Near-duplicates by SimHash with meet-in-the-middle ball hashing.

Two fingerprints at most R bits apart agree within R/2 bits in one of their two halves, and then
some value lies at most R/4 bits from both halves. So every distinct fingerprint emits, for each
half, all values within R/4 of it (66 keys for 64 bits and R = 4), keys are shuffled,
and colliding fingerprints are verified on all 64 bits. Emitting the whole 64-bit ball of half
the radius is the same idea with 2,081 keys for each fingerprint; the halves need 66.

Only distinct fingerprints are emitted, so copies cost nothing; inside a colliding group a
breadth-first search links members to those not yet reached, so a dense group needs few
comparisons and gives one edge for each member, never all pairs. Keys met by very many distinct
fingerprints are split again by the 16-bit quarters of the other half, by the same rule.

Defined cases: missing and empty texts have no words and fingerprint zero, linked like any other;
shorter texts are one shingle; rows with a missing id get a fingerprint but no class (null); repeated ids
form one row each with equal class.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .tables import map_texts, materialize, parts

SHINGLE = 4
RADIUS = 4
SEED = 42
HOT_KEY = 20_000      # distinct fingerprints under one key from which it is split again


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set when more than half of the shingles' XXH64 values have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(e + 1 for e in ends)]
    slices = map(joined.__getitem__, map(slice, starts, ends[shingle - 1:]))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Kept columns and the fingerprint, as a signed 64-bit integer."""
    def run(texts: pa.Array) -> list:
        values = [fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(values, np.uint64).view(np.int64))]

    return map_texts(docs, keep, [T.StructField("fingerprint", T.LongType())], run, text=text)


def _keys(value: str, bits: int, radius: int, tag: str, parts_of: int):
    """For each equal part of the low ``bits`` of ``value``: all part values within ``radius`` (0 or 1) bits."""
    width = bits // parts_of
    masks = ",".join(["0L", *(f"{1 << i}L" for i in range(width))] if radius else ["0L"])
    each = [f"transform(array({masks}), m -> named_struct('{tag}', {i}, 'key', (shiftrightunsigned({value}, {i * width}) & {(1 << width) - 1}L) ^ m))"
            for i in range(parts_of)]
    return f"explode(concat({','.join(each)}))"


def links(distinct: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (a, b) between the representatives of ``distinct(fingerprint, rep)`` that span every
    class of fingerprints linked within ``radius`` (at most 5) bits."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must lie between 0 and 5")
    middle = 1 if radius >= 2 else 0          # one half differs by two bits at most: both meet one bit away
    variants = distinct.select("fingerprint", "rep", F.expr(_keys("fingerprint", 64, middle, "half", 2)).alias("k")) \
        .select("fingerprint", "rep", "k.half", "k.key")
    # A key's group holds no more than the halves within one bit of it; rare halves cannot make a key hot.
    share = max(2, hot_key // 33)
    frequent = distinct.select("fingerprint", F.expr(_keys("fingerprint", 64, 0, "half", 2)).alias("k")) \
        .groupBy("k.half", "k.key").count().where(F.col("count") >= share)
    hot = frequent.select("half", "count", F.expr(_keys("key", 32, middle, "none", 1)).alias("k")) \
        .groupBy("half", "k.key").agg(F.sum("count").alias("n")).where(F.col("n") >= hot_key).select("half", "key")
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return _collide(variants.select("fingerprint", "rep", (F.col("half") * F.lit(1 << 32) + F.col("key")).alias("key")), radius)
    plain = variants.join(hot, ["half", "key"], "left_anti") \
        .select("fingerprint", "rep", F.xxhash64("half", "key").alias("key"))
    other = "CASE WHEN half = 0 THEN shiftrightunsigned(fingerprint, 32) ELSE fingerprint & 4294967295L END"
    again = variants.join(hot, ["half", "key"]).withColumn("other", F.expr(other)) \
        .select("fingerprint", "rep", "half", "key", F.expr(_keys("other", 32, middle, "quarter", 2)).alias("k")) \
        .select("fingerprint", "rep", F.xxhash64("half", "key", "k.quarter", "k.key").alias("key"))
    return _collide(plain.unionByName(again), radius)


def _collide(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges among the rows of each key, verified on all bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key, value, rep = (rows[c].to_numpy() for c in ("key", "fingerprint", "rep"))
        order = np.argsort(key, kind="stable")
        key, value, rep = key[order], value[order].view(np.uint64), rep[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        found: list[np.ndarray] = []
        twos = starts[sizes == 2]
        near = np.bitwise_count(value[twos] ^ value[twos + 1]) <= radius
        found.append(np.stack([rep[twos[near]], rep[twos[near] + 1]]))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found.append(_span(value[start:start + size], rep[start:start + size], radius))
        a, b = np.concatenate(found, axis=1)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return keyed.repartition(parts(keyed.sparkSession), "key").mapInArrow(run, "a long, b long")


def _span(value: np.ndarray, rep: np.ndarray, radius: int) -> np.ndarray:
    """Tree edges of the classes in one group: a member reached is compared with those not reached yet."""
    left = np.arange(len(value))
    out: list[tuple[int, np.ndarray]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        root = queue[0]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(value[left] ^ value[at]) <= radius
            if near.any():
                reached = left[near]
                out.append((rep[root], rep[reached]))
                queue.extend(reached.tolist())
                left = left[~near]
    if not out:
        return np.zeros((2, 0), np.int64)
    return np.stack([np.concatenate([np.full(len(x), r) for r, x in out]), np.concatenate([x for _, x in out])])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(id, fingerprint, component_id): the class of every document, named by its smallest id."""
    marked = materialize(fingerprints(docs.select(id_column, text), [id_column], text, shingle), "fingerprints")
    distinct = materialize(marked.where(F.col(id_column).isNotNull()).groupBy("fingerprint").agg(F.min(id_column).cast("long").alias("rep")), "distinct")
    found = components(links(distinct, radius, hot_key))
    named = distinct.join(found, distinct["rep"] == found["node"], "left") \
        .select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "classes")
    return marked.join(named, "fingerprint", "left") \
        .select(id_column, "fingerprint", F.when(F.col(id_column).isNotNull(), F.col("component_id")).alias("component_id"))
