"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of every whole text are written once. Trees are grown on a bounded, hash-chosen sample of
labelled rows: values are binned at sample quantiles, and each level of a tree takes one histogram of
gradients for all its nodes. Trees are complete and flattened into arrays (feature, threshold, leaf),
so scoring is a fixed number of numpy steps for a batch.

Defined cases: missing and empty texts have all-zero statistics and get a score; labels that are missing or contradict each
other are left out; without labelled rows of both classes the score is the share of
label 1 (1 without any labels); a missing id is never held out; repeated rows get equal scores; extra columns play no part.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bytescan import scan
from .tables import map_texts, materialize
from .textstats import base_counts

SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LAMBDA, MIN_ROWS = 64, 5, 60, 0.15, 1.0, 20
PREDICT_FROM = 0.3

STATS = ["log_words", "word_length", "symbols", "repeat_lines", "repeat_words", "upper", "digits", "marks", "pipes",
         "exclaims", "non_ascii", "distinct_words", "line_words", "log_lines", "long_words", "short_words", "spaces",
         "stops", "same_pairs", "upper_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; shares of words, characters or lines."""
    s = scan(texts)
    c = base_counts(s)
    words, size = np.maximum(1, c["n_words"]), np.maximum(1, s.ends - s.starts)
    owner, starts, ends = c["_owner"], c["_starts"], c["_ends"]
    length = ends - starts
    d = s.data

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[s.ends] - total[s.starts]) / size

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=s.n) / words

    upper = (d >= 65) & (d <= 90)
    digit = (d >= 48) & (d <= 57)
    mark = ((d > 32) & (d < 48)) | ((d > 57) & (d < 65)) | ((d > 90) & (d < 97)) | ((d > 122) & (d < 127))
    keys = np.stack([owner.astype(np.uint64), c["_hashes"]], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    distinct = np.bincount(owner[order[first]], minlength=s.n)
    same = np.zeros(len(owner), bool)
    same[1:] = (owner[1:] == owner[:-1]) & (c["_hashes"][1:] == c["_hashes"][:-1])
    lines = np.maximum(1, c["n_lines"])
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / size, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, share(upper), share(digit), share(mark), share(d == 124), share(d == 33), share(d >= 128),
        distinct / words, c["n_words"] / lines, np.log1p(c["n_lines"]), of_words(length >= 10), of_words(length <= 3),
        share(s.space), share(d == 46), of_words(same), of_words(upper[starts] & upper[ends - 1]) if len(starts) else np.zeros(s.n),
    ], axis=1).astype(np.float64)


@dataclass
class Trees:
    """Complete trees of equal depth: node k has children 2k+1 and 2k+2; a value over the threshold goes right."""
    feature: np.ndarray     # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray        # trees x 2^depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner, depth = self.feature.shape[1], self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Trees(np.zeros((trees, 2 ** depth - 1), np.int64), np.full((trees, 2 ** depth - 1), np.inf),
                  np.zeros((trees, 2 ** depth)), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    slots = binned + np.arange(width) * bins
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, base = 2 ** level, 2 ** level - 1
            at = ((node - base)[:, None] * (width * bins) + slots).ravel()
            shape = (count, width, bins)
            g, h, m = (np.bincount(at, w, count * width * bins).reshape(shape).cumsum(axis=2)
                       for w in (np.repeat(gradient, width), np.repeat(hessian, width), np.ones(n * width)))
            gain = g ** 2 / (h + LAMBDA) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + LAMBDA) - g[..., -1:] ** 2 / (h[..., -1:] + LAMBDA)
            gain[(m < MIN_ROWS) | (m[..., -1:] - m < MIN_ROWS)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, cut = divmod(int(best[k]), bins)
                if gain[k, j, cut] > 1e-9 and cut < len(cuts[j]):
                    model.feature[t, base + k], model.threshold[t, base + k] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - (2 ** depth - 1)
        g, h = np.bincount(leaf, gradient, 2 ** depth), np.bincount(leaf, hessian, 2 ** depth)
        model.leaf[t] = -rate * g / (h + LAMBDA)
        margin += model.leaf[t][leaf]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
                  folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, predict_from: float = PREDICT_FROM) -> DataFrame:
    """(id, held_out, score, predicted) for every document; rows whose crc32(id) mod ``folds`` is ``held`` teach nothing."""
    fields = [T.StructField("stats", T.BinaryType())]
    stats = materialize(map_texts(docs, [id_column], fields, lambda t: [[row.tobytes() for row in statistics(t)]], text=text), "stats")
    out = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == held, F.lit(False))
    taught = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & ~out)
    taught = (taught.groupBy(F.col(id_column).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "_y"))
    # At most sample_rows rows of two numbers are sent to the executors, and as many rows of statistics come back: one for each id.
    rows = stats.join(F.broadcast(taught), F.col(id_column) == F.col("_id")).groupBy("_id", "_y").agg(F.min("stats").alias("stats")).collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["stats"])))
    y = np.array([r["_y"] for r in rows], float)
    if len(set(y)) == 2:
        model = grow(np.frombuffer(b"".join(bytes(r["stats"]) for r in rows)).reshape(len(rows), -1), y)
    else:
        model = Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), 35.0 if not len(y) or y[0] == 1 else -35.0)
    scored = _score(stats.select(F.col(id_column), "stats", out.alias("held_out")), model)
    return scored.select(id_column, "held_out", "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))


def _score(stats: DataFrame, model: Trees) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.score(x))],
                                             names=[batch.schema.names[0], "held_out", "score"])

    kept = T.StructType([*stats.schema.fields[:1], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return stats.mapInArrow(run, kept)
