"""Quality rules: form limits plus a calibrated logistic regression over hashed n-grams.

Features are relative frequencies of hashed words, word pairs and character trigrams (code
points), so a text's score is a mean of weights and needs one gather per n-gram. The weights
are fitted on a bounded sample of labelled rows; Platt's sigmoid, fitted on the part of the
sample left out of the fit, turns the margin into a probability, which is held against a fixed limit.

Defined cases: a missing or empty text has no words and fails the base rule; labels that are
missing, or rows with contradicting labels, are left out; with no labelled row of either class
there is nothing to tell apart and every text that passes the base rule is kept. Rows are
scored one by one, so repeated rows get equal verdicts and extra columns pass through.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bytescan import U, Scan, mix, scan, sums
from .tables import map_texts, text_of
from .textstats import base_counts

BITS = 15                 # 2^15 weights for words and pairs, as many for character trigrams
SAMPLE_ROWS = 3000        # labelled rows used for the fit, at most
KEEP_FROM = 0.3           # calibrated probability of good quality
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Model:
    weights: np.ndarray       # word slots, then character slots
    bias: float
    slope: float = 1.0        # of the calibration
    shift: float = 0.0


def _grams(s: Scan, counts: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words with pairs, and for trigrams: slots in text order, first and last index of each text."""
    size = 1 << BITS
    hashes, owner = counts["_hashes"], counts["_owner"]
    firsts = np.searchsorted(counts["_starts"], s.starts)
    lasts = np.searchsorted(counts["_starts"], s.ends)
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1] + U(7) * hashes[1:]) if len(hashes) > 1 else hashes[:0]
    pairs = np.where(owner[1:] == owner[:-1], pairs, hashes[:-1]) if len(hashes) > 1 else pairs
    both = np.empty(2 * len(hashes), np.uint64)
    both[0::2] = hashes
    both[1::2] = np.concatenate([pairs, hashes[-1:]])
    words = (both & U(size - 1)).astype(np.int64), 2 * firsts, 2 * lasts
    lead = (s.data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    codes = np.frombuffer(s.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        third = codes[:-2] * U(0x9E3779B97F4A7C15) + codes[1:-1] * U(0xC2B2AE3D27D4EB4F) + codes[2:] * U(0x165667B19E3779F9) \
            if len(codes) > 2 else codes[:0]
    slots = (third >> U(64 - BITS)).astype(np.int64) + size
    first, last = at[s.starts], np.maximum(at[s.ends] - 2, at[s.starts])
    return [words, (slots, np.minimum(first, len(slots)), np.minimum(last, len(slots)))]


def _features(s: Scan, counts: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text's frequency vector."""
    out = []
    grams = _grams(s, counts)
    for i in range(s.n):
        slots, values = [], []
        for at, first, last in grams:
            found, n = np.unique(at[first[i]:last[i]], return_counts=True)
            slots.append(found)
            values.append(n / max(1, n.sum()))
        out.append((np.concatenate(slots), np.concatenate(values)))
    return out


def margins(model: Model, s: Scan, counts: dict) -> np.ndarray:
    total = np.full(s.n, model.bias)
    for at, first, last in _grams(s, counts):
        total += sums(model.weights[at], first, last) / np.maximum(1, last - first)
    return total


def probability(model: Model, margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_column: str = "doc_id",
                    text: str = "text", label: str = "quality", where=None) -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of the id: (id, label, text).

    The labels sent to all executors are these rows only, so their size is bounded by ``rows``. Of rows that share
    an id one text is taken, chosen by its hash, before anything reaches the driver.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
    if where is not None:
        wanted = wanted.where(where)
    wanted = (wanted.groupBy(F.col(id_column).alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
              .where("_label = _most").orderBy(F.xxhash64("_id"), "_id").limit(rows))
    met = docs.select(F.col(id_column).alias("_id"), text_of(text).alias("_text")).join(F.broadcast(wanted.select("_id", "_label")), "_id")
    return met.groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.length("_text"))).alias("_text"))


def fit(sample: DataFrame) -> Model | None:
    """Fits weights on three quarters of the sample and the calibration on the rest."""
    fields = [T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())]

    def run(texts: pa.Array) -> list:
        s = scan(texts)
        pairs = _features(s, base_counts(s))
        return [[a.astype(np.int32).tobytes() for a, _ in pairs], [v.astype(np.float32).tobytes() for _, v in pairs]]

    rows = map_texts(sample, ["_id", "_label"], fields, run, text="_text").collect()
    rows.sort(key=lambda r: (r["_id"], r["slots"], r["values"]))
    y = np.array([r["_label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    slots = [np.frombuffer(r["slots"], np.int32) for r in rows]
    values = [np.frombuffer(r["values"], np.float32) for r in rows]
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    model = _logistic([s for s, h in zip(slots, held) if not h], [v for v, h in zip(values, held) if not h], y[~held])
    margin = np.array([model.bias + model.weights[s] @ v for s, v in zip(slots, values)])
    use = held if held.any() else ~held
    model.slope, model.shift = _platt(margin[use], y[use])
    return model


def _logistic(slots: list, values: list, y: np.ndarray, steps: int = 120, rate: float = 4.0, ridge: float = 1e-6) -> Model:
    """Balanced logistic regression by full-batch AdaGrad over sparse rows."""
    ends = np.cumsum([len(s) for s in slots])
    starts = ends - [len(s) for s in slots]
    row = np.repeat(np.arange(len(y)), ends - starts)
    at, value = np.concatenate(slots), np.concatenate(values).astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias = np.zeros(2 << BITS), 0.0
    squares, bias_square = np.full(2 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        margin = sums(w[at] * value, starts, ends) + bias
        slope = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) * weight
        gradient = np.bincount(at, slope[row] * value, minlength=len(w)) + ridge * w
        squares += gradient ** 2
        bias_square += slope.sum() ** 2
        w -= rate * gradient / np.sqrt(squares)
        bias -= 0.1 * slope.sum() / np.sqrt(bias_square)
    return Model(w, bias)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with smoothed targets, by Newton steps."""
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, float(np.log((positive + 1) / (negative + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * margin ** 2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(d * margin).sum(), d.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (max(float(a), 1e-3), float(b))


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
                  keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """Kept columns of every document plus the base counts, ``base_failed``, ``probability`` and ``kept``."""
    model = fit(labelled_sample(docs, labels, sample_rows, id_column, text))
    return apply_rules(docs, model, docs.columns if keep is None else keep, text, keep_from)


def apply_rules(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    def run(texts: pa.Array) -> list:
        s = scan(texts)
        counts = base_counts(s)
        n, again = counts["n_words"], counts["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
        p = np.ones(s.n) if model is None else probability(model, margins(model, s, counts))
        return [*(counts[c] for c in BASE), failed, p, ~failed & (p >= keep_from)]

    fields = [*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()),
              T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_texts(docs, keep, fields, run, text=text)
