"""Many regularised logistic regressions in one fit: one pass over the rows for each Newton step of all models.

A row says in ``use`` which models learn from it, so leave-one-site-out fits need no copy of the rows for each
site. Tasks add up loss, gradient and curvature of every model over their Arrow batches and send one row for each
number; what is shuffled and what reaches the driver has a size given by models and columns, not by rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordering import exact_quantiles

TOLERANCE = 1e-6


@dataclass
class Logistic:
    """One fitted model over positions of the feature array; ``weights`` and ``intercept`` act on filled, unscaled values."""

    columns: list[int]
    fill: np.ndarray
    weights: np.ndarray
    intercept: float
    rows: int
    positives: int


def fit(rows: DataFrame, columns: Sequence[Sequence[int]], c: float = 1.0, standardise: bool = True, iterations: int = 100,
        x: str = "x", use: str = "use", target: str = "target", weight: str | None = None) -> list[Logistic | None]:
    """Model m sees ``columns[m]`` of the array ``x`` in the rows whose ``use`` holds m.

    Missing values take the exact median of the model's own rows, columns are standardised (a constant one
    counts as zero), weights pay ``0.5 / c`` times their square. Rows without a target teach nothing. ``rows`` is read once a step: give a written table.
    A model whose rows have a single class, or that has no rows, is None. The array ``weight`` says how many equal rows a row
    stands for in each model of its ``use``.
    """
    columns = [list(m) for m in columns]
    rows = rows.where(F.col(target).isNotNull())
    fill = _fills(rows, columns, x, use, weight)
    first = _totals(rows, x, use, target, weight, columns, lambda m, v, y, w: np.concatenate([[w.sum(), w @ y], w @ _filled(v, fill[m])]))
    live = [m for m, t in first.items() if 0 < t[1] < t[0]]
    mean = {m: first[m][2:] / first[m][0] if standardise else np.zeros(len(columns[m])) for m in live}
    spread = {m: np.ones(len(columns[m])) for m in live}
    if standardise:
        squares = _totals(rows, x, use, target, weight, [columns[m] if m in mean else None for m in range(len(columns))],
                          lambda m, v, y, w: w @ (_filled(v, fill[m]) - mean[m]) ** 2)
        for m in live:
            s = np.sqrt(squares[m] / max(first[m][0] - 1, 1))
            spread[m] = np.where(s > 1e-12 * np.maximum(np.abs(mean[m]), 1e-300), s, np.inf)
    beta = _newton(rows, x, use, target, weight, columns, live, fill, mean, spread, 1.0 / c, iterations)
    fitted: list[Logistic | None] = [None] * len(columns)
    for m in live:
        weights = beta[m][1:] / spread[m]
        fitted[m] = Logistic(columns[m], fill[m], weights, float(beta[m][0] - weights @ mean[m]), int(first[m][0]), int(first[m][1]))
    return fitted


def _newton(rows, x, use, target, weight, columns, live, fill, mean, spread, penalty, iterations) -> dict[int, np.ndarray]:
    """Newton steps of all models together; a step that raises a model's loss is halved."""
    beta = {m: np.zeros(len(columns[m]) + 1) for m in live}
    step = {m: np.zeros(len(columns[m]) + 1) for m in live}
    loss = {m: np.inf for m in live}
    open_models = set(live)
    for _ in range(iterations):
        if not open_models:
            break
        at = {m: beta[m] + step[m] for m in open_models}

        def part(m: int, v: np.ndarray, y: np.ndarray, w: np.ndarray, at=at) -> np.ndarray:
            z = np.hstack([np.ones((len(y), 1)), (_filled(v, fill[m]) - mean[m]) / spread[m]])
            score = z @ at[m]
            p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            curve = (z * (w * p * (1 - p))[:, None]).T @ z
            return np.concatenate([[w @ (np.logaddexp(0, score) - y * score)], z.T @ (w * (p - y)), curve.ravel()])

        sums = _totals(rows, x, use, target, weight, [columns[m] if m in open_models else None for m in range(len(columns))], part)
        for m in list(open_models):
            k = len(at[m])
            shrink = np.full(k, penalty)
            shrink[0] = 0
            now = sums[m][0] + 0.5 * float(shrink @ at[m] ** 2)
            if now > loss[m] + 1e-10 * abs(loss[m]):
                step[m] = step[m] / 2
            else:
                beta[m], loss[m] = at[m], now
                step[m] = -np.linalg.solve(sums[m][1 + k:].reshape(k, k) + np.diag(shrink), sums[m][1:1 + k] + shrink * at[m])
            if np.abs(step[m]).max() <= TOLERANCE * (1 + np.abs(beta[m]).max()):
                # What is left after a step this small is about its square.
                beta[m] = beta[m] + step[m]
                open_models.discard(m)
    return beta


def _filled(v: np.ndarray, fill: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(v), fill, v)


def _fills(rows: DataFrame, columns: list[list[int]], x: str, use: str, weight: str | None) -> dict[int, np.ndarray]:
    """Medians of each model's rows, looked up only for columns where a value is missing."""
    fill = {m: np.zeros(len(c)) for m, c in enumerate(columns)}
    width = 1 + max((max(c, default=0) for c in columns), default=0)
    missing = lambda i: F.col(x)[i].isNull() | F.isnan(F.col(x)[i])
    gaps = rows.agg(*[F.count_if(missing(i)).alias(f"g{i}") for i in range(width)]).first()
    holes = [i for i in range(width) if gaps[i]]
    if holes:
        values = F.array(*[F.struct(F.lit(i).alias("at"), F.col(x)[i].alias("value")) for i in holes])
        present = "value IS NOT NULL AND NOT isnan(value)"
        if weight is None:
            # Equal values of rows with the same models are counted before they go to each model.
            equal = rows.select(F.col(use).alias("use"), F.inline(values)).where(present).groupBy("use", "at", "value").agg(F.count(F.lit(1)).alias("rows"))
            long = equal.select(F.explode("use").alias("model"), "rows", "at", "value")
        else:
            members = F.arrays_zip(F.col(use).alias("model"), F.col(weight).alias("rows"))
            long = rows.select(F.inline(members).alias("model", "rows"), values.alias("v")).select("model", "rows", F.inline("v")).where(present)
        for r in exact_quantiles(long, ["model", "at"], "value", [0.5], ["median"], "rows").collect():
            if r["at"] in columns[r["model"]]:
                fill[r["model"]][columns[r["model"]].index(r["at"])] = r["median"]
    return fill


def _totals(rows: DataFrame, x: str, use: str, target: str, weight: str | None, columns: Sequence[Sequence[int] | None],
            part: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The sum of ``part`` over all rows of each model that has columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            member = batch.column(1)
            models = member.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), member.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            share = np.ones(len(at)) if weight is None else batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(models, kind="stable")
            names, starts = np.unique(models[order], return_index=True)
            for m, members in zip(names.tolist(), np.split(order, starts[1:])):
                if columns[m] is not None:
                    chosen = at[members]
                    found = part(m, wide[np.ix_(chosen, columns[m])], y[chosen], share[members])
                    held[m] = held[m] + found if m in held else found
        for m, total in held.items():
            yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(total), m), pa.int32()), "at": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

    counted = [] if weight is None else [weight]
    summed = rows.select(x, use, F.col(target).cast("double"), *counted).mapInArrow(run, "model int, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value"))
    out: dict[int, list[tuple[int, float]]] = {}
    for r in summed.collect():
        out.setdefault(r["model"], []).append((r["at"], r["value"]))
    return {m: np.array([v for _, v in sorted(pairs)]) for m, pairs in out.items()}


def score(models: Sequence[Logistic | None], model: Column, x: Column | None = None) -> Column:
    """The positive-class probability by the model of that number; NULL where there is none."""
    x = F.col("x") if x is None else x
    number = lambda v: F.lit(float(v))
    terms = F.array(*[F.array(*[F.struct(F.lit(i).alias("at"), number(f).alias("fill"), number(w).alias("weight"))
                                for i, f, w in zip(m.columns, m.fill, m.weights)]) if m else F.lit(None) for m in models])
    terms = terms.cast("array<array<struct<at:int,fill:double,weight:double>>>")
    start = F.array(*[number(m.intercept) if m else F.lit(None) for m in models]).cast("array<double>")
    value = lambda t: F.coalesce(F.nanvl(x[t["at"]], F.lit(None).cast("double")), t["fill"])
    total = F.aggregate(F.get(terms, model), F.get(start, model), lambda s, t: s + value(t) * t["weight"])
    return 1 / (1 + F.exp(-total))
