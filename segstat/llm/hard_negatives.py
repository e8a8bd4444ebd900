"""Hard negatives of anchor vectors, mined by a secondary sort.

Rows and anchors are packed in blocks of bounded size; every block of anchors meets every block of rows once (a
stated set of queries against all rows), and a cell of that grid is one integer matrix product. Each
pair that may count becomes a packed key (anchor, descending score, id): keys are shuffled by anchor and
sorted within partitions, and one pass over each partition opens a window at every positive and emits the
negatives that fall into it. The pass holds the windows of one anchor, never its rows.

What a cell sends is reduced without loss before the shuffle. The first pass gives each anchor its
positives: a cell sends its best ``positives`` of the anchor's label. The second knows their
scores, so a cell sends its first ``negatives`` of each window; the positives' own keys join them.

Scores are exact: products are taken in doubles where no sum can reach 2^53, in 64-bit integers where none can overflow;
beyond that the query ends with an error.

Defined cases: rows with a missing label, vector or component, or a component that is not finite, take no
part; a shorter vector counts as padded by zeros; a missing id stands before all others and is no anchor; rows that
share an id are rows of their own, told apart by their place, and a repeated anchor
gives its rows once for each copy; a positive below zero has no window; empty tables give no rows; extra columns play no part.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import materialize, parts

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90              # per cent of the positive's score
ROW_BLOCK, ANCHOR_BLOCK = 2048, 512
_SIGN = np.uint64(1 << 63)
_BLOCK = "dim int, kind string, uids binary, ids binary, named binary, labels binary, vectors binary"
_KEY = [("anchor", ">u8"), ("score", ">u8"), ("named", "u1"), ("id", ">u8"), ("uid", ">u8"), ("positive", "u1"), ("anchor_id", ">u8")]


def usable(rows: DataFrame, id_column: str, vector: str, label: str, is_anchor: Column) -> DataFrame:
    """uid, id, label, v (components times 256, rounded down) and is_anchor of the rows that take part."""
    values = F.col(vector)
    whole = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    kept = rows.where(F.col(label).isNotNull() & values.isNotNull() & whole)
    scaled = F.transform(values, lambda x: F.floor(x.cast("double") * 256))
    return kept.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("v"),
                       (F.coalesce(is_anchor, F.lit(False)) & F.col(id_column).isNotNull()).alias("is_anchor")) \
        .withColumn("uid", F.monotonically_increasing_id())


def _row_blocks(rows: DataFrame) -> DataFrame:
    """Rows packed, as their partitions hold them, into blocks of at most ``ROW_BLOCK``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                yield pa.RecordBatch.from_pylist([{"block": part.column(0)[0].as_py(), **_packed(*part.columns)}], schema=_schema("block long, " + _BLOCK))

    return rows.select("uid", "id", "label", "v").mapInArrow(pack, "block long, " + _BLOCK)


def _anchor_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors dealt by a hash of their place into n blocks of about ``ANCHOR_BLOCK``; ``scores``: those of their positives."""
    named = anchors.select(F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("number"), "uid", "id", "label", "v", "scores")
    grouped = named.groupBy("number").agg(*[F.collect_list(F.struct("uid", "id", "label", "v", "scores")).alias("rows")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(1)[i].values
                row = {"number": batch.column(0)[i].as_py(), **_packed(*[rows.field(c) for c in ("uid", "id", "label", "v")]), "scores": rows.field("scores").to_pylist()}
                yield pa.RecordBatch.from_pylist([row], schema=_schema("number int, " + _BLOCK).append(pa.field("scores", pa.list_(pa.list_(pa.int64())))))

    return grouped.mapInArrow(pack, f"number int, {_BLOCK}, scores array<array<long>>")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _packed(uid: pa.Array, ids: pa.Array, label: pa.Array, v: pa.Array) -> dict:
    lengths = np.array([len(x) for x in v], np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    dim = int(lengths.max())
    wide = np.zeros((len(v), dim), np.int64)
    wide[np.arange(dim) < lengths[:, None]] = flat
    most = int(max(-int(flat.min()), int(flat.max()))) if len(flat) else 0
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if most < 1 << bits)
    return {"dim": dim, "kind": kind, "uids": uid.to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            "named": ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
            "labels": label.to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "vectors": wide.astype(kind).tobytes()}


class _Block:
    def __init__(self, row: dict, prefix: str):
        get = lambda name: row[prefix + name]
        self.uids, self.ids, self.labels = (np.frombuffer(get(c), np.int64) for c in ("uids", "ids", "labels"))
        self.named = np.frombuffer(get("named"), np.uint8)
        self.vectors = np.frombuffer(get("vectors"), get("kind")).reshape(len(self.uids), get("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b; the shorter rows end in zeros."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim].astype(np.int64), b[:, :dim].astype(np.int64)
    most = dim * max((max(-int(a.min()), int(a.max())) if a.size else 0), 1) * max((max(-int(b.min()), int(b.max())) if b.size else 0), 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("scores of these vectors may not fit in 64 bits")


def _cells(rows: DataFrame, anchors: DataFrame, n: int, emit) -> DataFrame:
    """Packed keys that ``emit(anchor block, row block, order, sorted scores, scores of positives)`` gives for each cell of the grid."""
    copies = max(1, -(-2 * parts(rows.sparkSession) // n))      # of each anchor block, so that few of them still make many tasks
    left = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("number"),
                       F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"))
    right = anchors.select("number", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "number"], F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    cells = left.join(right, ["number", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                r, a = _Block(row, "r_"), _Block(row, "a_")
                by_id = np.lexsort((r.uids, r.ids, r.named))
                for c in ("uids", "ids", "labels", "named", "vectors"):
                    setattr(r, c, getattr(r, c)[by_id])
                scores = products(a.vectors, r.vectors)
                order = np.argsort(-scores, axis=1, kind="stable")
                keys = emit(a, r, order, np.take_along_axis(scores, order, 1), row["a_scores"])
                if len(keys):
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
                    yield pa.RecordBatch.from_arrays([packed.cast(pa.binary())], names=["key"])

    return cells.mapInArrow(run, "key binary")


def _keys(a: _Block, at: int, r: _Block, rows: np.ndarray, scores: np.ndarray, positive: bool) -> np.ndarray:
    """Keys whose byte order is: anchor, higher scores, smaller ids, place."""
    out = np.empty(len(rows), _KEY)
    out["anchor"], out["anchor_id"] = a.uids[at].astype(np.uint64), a.ids[at].astype(np.uint64)
    out["score"] = ~(scores.astype(np.uint64) ^ _SIGN)
    out["named"], out["id"], out["uid"] = r.named[rows], r.ids[rows].astype(np.uint64) ^ _SIGN, r.uids[rows].astype(np.uint64)
    out["positive"] = positive
    return out


def _joined(found: list[np.ndarray]) -> np.ndarray:
    # Joining structured arrays turns their fields to the machine's byte order.
    return np.concatenate(found).astype(_KEY) if found else np.empty(0, _KEY)


def _sorted(keys: DataFrame) -> DataFrame:
    """The secondary sort: keys of an anchor in one partition, in the order of their bytes."""
    return keys.repartition(parts(keys.sparkSession), F.substring("key", 1, 8)).sortWithinPartitions("key")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Fields of each key, in order: anchor, score, id or None, positive, anchor id."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), _KEY)
        scores = (~keys["score"].astype(np.uint64) ^ _SIGN).astype(np.int64).tolist()
        ids = (keys["id"].astype(np.uint64) ^ _SIGN).astype(np.int64).tolist()
        ids = [i if named else None for i, named in zip(ids, keys["named"].tolist())]
        yield from zip(keys["anchor"].tolist(), scores, ids, keys["positive"].tolist(), keys["anchor_id"].astype(np.int64).tolist(), batch.column(0).to_pylist())


def mine(rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A negative has another label and low * positive score <= 100 * negative score <= high * positive score.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows must end at or below their positive: 0 <= low <= high <= 100")
    table = materialize(usable(rows, id_column, vector, label, is_anchor), "vectors")
    row_blocks = materialize(_row_blocks(table), "row-blocks")
    anchors = table.where("is_anchor").drop("is_anchor")
    n = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    plain = materialize(_anchor_blocks(anchors.withColumn("scores", F.expr("CAST(NULL AS array<bigint>)")), n), "anchor-blocks")

    def best(a: _Block, r: _Block, order: np.ndarray, ranked: np.ndarray, _) -> np.ndarray:
        same = (r.labels[order] == a.labels[:, None]) & (r.uids[order] != a.uids[:, None])
        found = []
        for i in range(len(a.uids)):
            at = np.flatnonzero(same[i])[:positives]
            found.append(_keys(a, i, r, order[i, at], ranked[i, at], True))
        return _joined(found)

    def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        held: list[tuple] = []
        for anchor, score, _, _, _, key in _stream(batches):
            last, taken = anchor, taken + 1 if anchor == last else 1
            if taken <= positives:
                held.append((anchor, score, key))
            if len(held) == 4096:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        anchors, scores, keys = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(scores, pa.int64()), pa.array(keys, pa.binary())], names=["anchor", "score", "key"])

    chosen = materialize(_sorted(_cells(row_blocks, plain, n, best)).mapInArrow(first_positives, "anchor long, score long, key binary"), "positives")
    windows = chosen.groupBy("anchor").agg(F.collect_set("score").alias("scores"))       # at most ``positives`` of them
    known = materialize(_anchor_blocks(anchors.join(windows, F.col("uid") == F.col("anchor")).drop("anchor"), n), "anchor-windows")

    def within(a: _Block, r: _Block, order: np.ndarray, ranked: np.ndarray, scores_of: list) -> np.ndarray:
        found = []
        for i, scores in enumerate(scores_of):
            wanted = np.zeros(len(r.uids), bool)
            other = np.flatnonzero(r.labels[order[i]] != a.labels[i])
            falling = -ranked[i, other]
            for s in scores or ():
                lo, hi = -(-low * s // 100), high * s // 100
                start = np.searchsorted(falling, -hi)
                wanted[other[start:min(start + negatives, np.searchsorted(falling, -lo, "right"))]] = True
            at = np.flatnonzero(wanted)
            found.append(_keys(a, i, r, order[i, at], ranked[i, at], False))
        return _joined(found)

    keys = _cells(row_blocks, known, n, within).unionByName(chosen.select("key"))
    return _sorted(keys).mapInArrow(lambda batches: _windows(_stream(batches), negatives, low, high),
                                    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _windows(stream: Iterator[tuple], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """One pass: positives open windows, negatives are emitted into every open window that they fall into."""
    current, level, ties, opened, out = None, None, [], [], []
    for anchor, score, row, positive, anchor_id, _ in stream:
        if anchor != current:
            current, level, ties, opened = anchor, None, [], []
        if score != level:
            level, ties = score, []                     # negatives of this score so far: one may stand before its positive
        if positive:
            window = [row, score, -(-low * score // 100), high * score // 100, 0]
            opened.append(window)
            met = [(window, n) for n in ties]
        else:
            opened = [w for w in opened if w[4] < negatives and score >= w[2]]
            if len(ties) < negatives:
                ties.append(row)
            met = [(w, row) for w in opened]
        for window, negative in met:
            if window[4] < negatives and window[2] <= score <= window[3]:
                window[4] += 1
                out.append((anchor_id, window[0], window[4], negative, window[1], score))
        if len(out) >= 4096:
            yield _found(out)
            out = []
    if out:
        yield _found(out)


def _found(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


ORACLE_SQL = f"""
WITH own AS (
  SELECT row_number() OVER () AS uid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (
  SELECT a.uid AS anchor, a.id AS anchor_id, r.uid, r.id, r.label = a.label AS same,
         CAST(coalesce(list_sum([a.v[i] * r.v[i] for i in range(1, least(len(a.v), len(r.v)) + 1)]), 0) AS BIGINT) AS score
  FROM own a JOIN own r ON a.id % 100 = 0 AND a.uid <> r.uid),
positive AS (
  SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
WINDOW w AS (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
