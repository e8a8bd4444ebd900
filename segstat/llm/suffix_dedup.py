"""Removal of repeated stretches of bytes by a sparse suffix array, sorted deep-shallow.

Every window of ``LENGTH`` bytes has an anchor, its leftmost gram of smallest hash, so equal windows have
anchors at equal offsets and only the suffixes that begin at anchors need sorting.

1. Each scan task finds the anchors of its texts, with a hash of the stretch that the anchor's windows cover, and keeps one entry
   for each gram and stretch; later ones in the task are repeats already. Entries are dealt by gram in packed blocks.
2. A gram met once has no repeat. A stretch met earlier is a repeat as a whole. A gram with several different stretches
   sends the first place of each to step 3.
3. The bytes of those stretches are fetched from the documents and dealt by gram. In each task the suffixes from the
   anchor, and the reversed prefixes before it, are sorted by multikey quicksort to a shallow depth and by blind tries below; a window is a
   repeat if an earlier entry shares its class in both orders at the window's lengths.
4. Repeated stretches of each document are merged and cut out.

Grams with very many stretches (``HOT``, or a 100,000th of all anchors if that is more) are found by a first pass; their
entries are dealt by window instead of gram, so none of them fills one task. The list of such grams has 100,000 entries at most.

Defined cases: a missing text is empty; texts shorter than ``LENGTH`` keep everything; a missing id orders
before all others; rows equal in id and text are one document and are treated alike; rows with one id and
different texts are different documents ordered by a hash of the text; extra columns pass through.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .anchors import GRAM, anchors
from .bytescan import U, Scan, mix, scan
from .suffix_sort import classes_at, sorted_classes
from .tables import materialize, parts, pieces, text_of

LENGTH = 100
HOT = 100_000
HOT_LIST = 100_000
_SLAB = 1 << 21            # bytes scanned at a time
_FLUSH = 1 << 20           # entries held before they are packed
_NO_ID = -(1 << 63)
_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("mark", "<u8"), ("stretch", "<u4"), ("start", "<u4"), ("windows", "u1"), ("offset", "u1")])


def _input(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    wide = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), text_of(text).alias("t"))
    return wide.select("id", F.xxhash64("t").alias("mark"), "t")


def _entries(s: Scan, ids: np.ndarray, marks: np.ndarray, length: int, hot: np.ndarray) -> np.ndarray:
    """One entry for each anchor; hot grams give one for each of their windows."""
    at, gram, first, last = anchors(s, length)
    owner = s.owner(at)
    out = np.zeros(len(at), _ENTRY)
    out["key"], out["offset"], out["windows"] = gram, at - first, last - first + 1
    cover = s.hashes(first, last + length)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        each = out["windows"][is_hot].astype(np.int64)
        begin = np.repeat(first[is_hot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        single = np.zeros(len(begin), _ENTRY)
        window = s.hashes(begin, begin + length)
        single["key"], single["windows"] = window, 1
        out = np.concatenate([out[~is_hot], single])
        cover = np.concatenate([cover[~is_hot], mix(window)])
        owner = np.concatenate([owner[~is_hot], s.owner(begin)])
        first = np.concatenate([first[~is_hot], begin])
    with np.errstate(over="ignore"):
        out["stretch"] = (mix(cover + out["offset"].astype(np.uint64) * U(0x9E3779B97F4A7C15) + out["windows"]) >> U(32)).astype(np.uint32)
    out["id"], out["mark"], out["start"] = ids[owner], marks[owner], first - s.starts[owner]
    return out


def _first_of_each(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of gram, stretch and place, and which open a new gram and stretch; equal places once."""
    order = np.lexsort((e["start"], e["mark"], e["id"], e["stretch"], e["key"]))
    e = e[order]
    same = np.zeros(len(e), bool)
    same[1:] = (e["key"][1:] == e["key"][:-1]) & (e["stretch"][1:] == e["stretch"][:-1])
    again = np.zeros(len(e), bool)
    again[1:] = same[1:] & (e["id"][1:] == e["id"][:-1]) & (e["mark"][1:] == e["mark"][:-1]) & (e["start"][1:] == e["start"][:-1])
    return e[~again], ~same[~again]


def _pack(e: np.ndarray) -> bytes:
    columns = b"".join(np.ascontiguousarray(np.diff(e[c], prepend=e[c][:1] * 0) if c == "id" else e[c]).tobytes() for c in _ENTRY.names)
    return pa.compress(columns, codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=n * _ENTRY.itemsize, codec="zstd", asbytes=True)
    out, at = np.zeros(n, _ENTRY), 0
    for c in _ENTRY.names:
        kind = _ENTRY[c]
        values = np.frombuffer(raw, kind, n, at)
        out[c] = np.cumsum(values) if c == "id" else values
        at += n * kind.itemsize
    return out


_ROWS = "id long, mark long, key long, start int, windows int, offset int, repeat boolean"


def _as_rows(e: np.ndarray, repeat: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(e["id"]), pa.array(e["mark"].view(np.int64) if e["mark"].flags.c_contiguous else e["mark"].copy().view(np.int64)),
         pa.array(e["key"].copy().view(np.int64)), pa.array(e["start"].astype(np.int32)), pa.array(e["windows"].astype(np.int32)),
         pa.array(e["offset"].astype(np.int32)), pa.array(np.full(len(e), repeat))],
        names=["id", "mark", "key", "start", "windows", "offset", "repeat"])


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Scan, np.ndarray, np.ndarray]]:
    for batch in pieces(batches, "t", _SLAB):
        yield scan(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)


def hot_grams(texts: DataFrame, length: int, hot: int) -> np.ndarray:
    """Grams with at least ``hot`` anchors (or a 100,000th of all), counted where a scan slab holds four or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, _ in _scans(batches):
            _, gram, _, _ = anchors(s, length)
            found, n = np.unique(gram, return_counts=True)
            often = n >= min(4, hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                                              pa.array(np.append(np.zeros(often.sum(), np.int64), len(gram)))], names=["key", "n", "total"])

    counted = texts.mapInArrow(run, "key long, n long, total long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = materialize(counted.where((F.col("n") >= hot) | (F.col("total") > 0)), "hot-grams")
    total = counted.agg(F.sum("total")).first()[0] or 0
    listed = counted.where(F.col("n") >= max(hot, total // HOT_LIST)).select("key").collect()
    return np.sort(np.array([r[0] for r in listed], np.int64).view(np.uint64))


def places(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Steps 1 and 2: rows of stretches that repeat as a whole, and of first places to be compared."""
    spark = texts.sparkSession
    buckets = 2 * parts(spark)
    listed = hot_grams(texts, length, hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            e, opens = _first_of_each(e)
            rest = e[~opens]
            e = e[opens]
            e = e[np.lexsort((e["start"], e["mark"], e["id"], e["key"] % U(buckets)))]
            cuts = np.searchsorted((e["key"] % U(buckets)).astype(np.int64), np.arange(buckets + 1))
            rows = [(b, cuts[b + 1] - cuts[b], _pack(e[cuts[b]:cuts[b + 1]]), False) for b in range(buckets) if cuts[b + 1] > cuts[b]]
            # Repeats within the task travel along, anywhere.
            for k, part in enumerate(np.array_split(rest, max(1, len(rest) >> 16))):
                if len(part):
                    rows.append((int(part["key"][0] % U(buckets)) if k == 0 else (k * 7919) % buckets, len(part), _pack(part), True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows])], names=["bucket", "n", "blob", "repeat"])

        for s, ids, marks in _scans(batches):
            e = _entries(s, ids, marks, length, listed)
            if len(e):
                held.append(e)
                n += len(e)
            if n >= _FLUSH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for n, blob, repeat in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                e = _unpack(blob, n)
                if repeat:
                    yield _as_rows(e, True)
                else:
                    held.append(e)
        if not held:
            return
        e, opens = _first_of_each(np.concatenate(held))
        key_opens = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
        stretches = np.bincount(np.cumsum(key_opens) - 1, opens)
        compare = opens & (stretches[np.cumsum(key_opens) - 1] > 1)
        for part, repeat in ((e[~opens], True), (e[compare], False)):
            for chunk in np.array_split(part, max(1, len(part) >> 16)):
                yield _as_rows(chunk, repeat)

    dealt = texts.mapInArrow(deal, "bucket int, n long, blob binary, repeat boolean")
    return dealt.repartition(parts(spark), "bucket").mapInArrow(meet, _ROWS)


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, mark, start, end) of stretches whose every window of ``length`` bytes also starts earlier."""
    texts = _input(docs, id_column, text)
    found = materialize(places(texts, length, hot), "places")
    whole = found.where("repeat").select("id", "mark", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    wanted = found.where("not repeat").groupBy("id", "mark").agg(
        F.collect_list(F.struct("key", "start", "windows", "offset")).alias("wanted"))
    met = texts.join(wanted.hint("merge"), ["id", "mark"])
    # Bytes, so that offsets count bytes.
    cut = met.select("id", "mark", F.expr(f"""explode(transform(wanted, w -> named_struct('key', w.key, 'start', w.start, 'windows', w.windows,
        'offset', w.offset, 'bytes', substring(cast(t AS binary), w.start + 1, w.windows - 1 + {length}))))""").alias("c"))
    cut = cut.select("id", "mark", "c.*").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _compare(pa.Table.from_batches(held), length)

    fresh = cut.repartition(parts(docs.sparkSession), "key").mapInArrow(compare, "id long, mark long, start int, end int")
    return whole.unionByName(fresh)


def _compare(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Step 3 for the stretches of some grams."""
    columns = {c: table[c].to_numpy() for c in ("id", "mark", "key", "start", "windows", "offset")}
    anchor = columns["start"].astype(np.int64) + columns["offset"]
    # Grouped by gram and, within it, in document order; the order of the marks is that of step 2.
    order = np.lexsort((anchor, columns["mark"].view(np.uint64), columns["id"], columns["key"]))
    columns = {c: v[order] for c, v in columns.items()}
    offset, windows = columns["offset"].astype(np.int64), columns["windows"].astype(np.int64)
    texts = table["bytes"].combine_chunks().take(pa.array(order)).to_pylist()
    right = sorted_classes([t[o:] for t, o in zip(texts, offset.tolist())], columns["key"])
    left = sorted_classes([t[:o][::-1] for t, o in zip(texts, offset.tolist())], columns["key"])
    n = len(texts)
    repeat = np.zeros((n, int(windows.max()) + 1), bool)
    # A window that begins i bytes before the anchor is the pair (last i bytes before, first length - i bytes from it).
    for i in range(int(offset.max()) + 1):
        valid = np.flatnonzero((offset - windows + 1 <= i) & (i <= offset))
        if len(valid) < 2:
            continue
        pair = classes_at(*left, i)[valid] * n + classes_at(*right, length - i)[valid]
        _, first = np.unique(pair, return_index=True)
        later = np.ones(len(valid), bool)
        later[first] = False
        again = valid[later]
        repeat[again, offset[again] - i] = True
    edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    start = columns["start"][row]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns["id"][row]), pa.array(columns["mark"][row]), pa.array((start + begin).astype(np.int32)),
         pa.array((start + stop - 1 + length).astype(np.int32))], names=["id", "mark", "start", "end"])


def dedup_stretches(docs: DataFrame, keep: list[str], id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
                    hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Kept columns, n_bytes, n_removed, n_spans and kept_sha256 (and kept_bytes) of every document."""
    cuts = repeats(docs, id_column, text, length, hot).groupBy("id", "mark") \
        .agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    keep = [c for c in keep if c not in added]
    wide = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_of(text)).alias("mark"),
                       text_of(text).alias("t"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    met = wide.join(cuts.hint("merge"), ["id", "mark"], "left").select(
        "row", F.col("t").cast("binary").alias("t"), F.expr("transform(cuts, c -> c.start)").alias("starts"), F.expr("transform(cuts, c -> c.end)").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut_out(*x) for x in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))]
            columns = [pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)),
                       pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())]
            if with_text:
                columns.append(pa.array([d[0] for d in done], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *added[:len(columns)]])

    schema = T.StructType([T.StructField("row", met.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in added[:3]),
                           T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_bytes", T.BinaryType())] if with_text else [])])
    return met.mapInArrow(run, schema).select("row.*", *schema.names[1:])


def cut_out(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of the text, the bytes removed and the number of maximal runs."""
    if not starts:
        return text, 0, 0
    kept, at, runs = [], 0, 0
    for start, end in sorted(zip(starts, ends)):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        at = max(at, end)
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs
