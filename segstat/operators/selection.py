"""Model selection tables, training diagnosis and evidence labels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bootstrap import paired

# Width limits of the capacity arms, window of recent progress, smallest improvement.
SMALL_MAX_WIDTH = 32
MEDIUM_MIN_WIDTH = 64
RECENT_WINDOW = 20
IMPROVEMENT = 1e-8


def best_seed(candidates: DataFrame, by: Sequence[str], order: Sequence[int], metric: str = "validation_auprc", seed: str = "seed") -> DataFrame:
    """Highest validation score per model; ties keep the configured seed order."""
    position = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(seed))
    window = Window.partitionBy(*by).orderBy(F.col(metric).desc(), position)
    return candidates.withColumn("_k", F.row_number().over(window)).where(F.col("_k") == 1).drop("_k")


def grid_complete(candidates: DataFrame, seeds: Sequence[int], by: Sequence[str] = ("normalization", "width")) -> DataFrame:
    """Whether each (mode, width) has exactly the expected seeds, once each."""
    per_seed = candidates.groupBy(*by, "seed").agg(F.count(F.lit(1)).alias("c"))
    got = per_seed.groupBy(*by).agg(F.sum("c").alias("n"), F.count_if(F.col("seed").isin(*seeds) & (F.col("c") == 1)).alias("expected"))
    return got.select(*by, "n", ((F.col("n") == len(seeds)) & (F.col("expected") == len(seeds))).alias("complete"))


def rejected_grids(candidates: DataFrame, seeds: Sequence[int], by: Sequence[str] = ("normalization", "width")) -> DataFrame:
    """The (mode, width) cells that no selection may use: a seed is missing, repeated or not expected."""
    return grid_complete(candidates, seeds, by).where("not complete").drop("complete").withColumn("status", F.lit("rejected_seed_grid"))


def capacity_summary(candidates: DataFrame, seeds: Sequence[int], metric: str = "validation_auprc") -> DataFrame:
    """Mean, spread and range over seeds per (mode, width), complete grids only; see ``rejected_grids`` for the others."""
    whole = grid_complete(candidates, seeds).where("complete").select("normalization", "width")
    return candidates.join(whole, ["normalization", "width"]).groupBy("normalization", "width").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(metric).alias("mean_" + metric), F.stddev_pop(metric).alias("std_" + metric),
        F.min(metric).alias("min_" + metric), F.max(metric).alias("max_" + metric))


def capacity_arm() -> Column:
    return F.when(F.col("width") <= SMALL_MAX_WIDTH, "small").when(F.col("width") >= MEDIUM_MIN_WIDTH, "medium")


def select_capacity(candidates: DataFrame, seeds: Sequence[int], metric: str = "validation_auprc") -> DataFrame:
    """Per mode and arm: the width with the best mean over seeds (ties: smaller), then its best seed (ties: smaller)."""
    summary = capacity_summary(candidates, seeds, metric).withColumn("arm", capacity_arm()).where(F.col("arm").isNotNull())
    widths = Window.partitionBy("normalization", "arm").orderBy(F.col("mean_" + metric).desc(), "width")
    chosen = summary.withColumn("_k", F.row_number().over(widths)).where(F.col("_k") == 1).select("normalization", "arm", "width", F.col("mean_" + metric).alias("width_mean"))
    best = Window.partitionBy("normalization", "arm").orderBy(F.col(metric).desc(), "seed")
    return (candidates.join(chosen, ["normalization", "width"]).withColumn("_k", F.row_number().over(best)).where(F.col("_k") == 1)
            .select("normalization", "arm", "width", "seed", metric, "width_mean"))


def matched_plan(candidates: DataFrame, seeds: Sequence[int], reference: str, other: str, metric: str = "validation_auprc") -> DataFrame:
    """Both modes at every seed of the reference mode's chosen width; a missing side is reported."""
    chosen = select_capacity(candidates, seeds, metric).where(F.col("normalization") == reference).select("arm", "width", "width_mean")
    wanted = chosen.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    side = lambda mode, name: candidates.where(F.col("normalization") == mode).select("width", "seed", F.col(metric).alias(name))
    joined = wanted.join(side(reference, "left_score"), ["width", "seed"], "left").join(side(other, "right_score"), ["width", "seed"], "left")
    found = F.col("left_score").isNotNull() & F.col("right_score").isNotNull()
    return joined.withColumn("status", F.when(found, "ok").otherwise("missing_pair"))


def seed_deltas(predictions: DataFrame, base: str, variants: Sequence[str], cluster: str = "cluster_id", keys: Sequence[str] = ("record_id", "seg_idx")) -> DataFrame:
    """Baseline minus each variant at the same seed, point differences only."""
    ours = predictions.where(F.col("model") == base).select("seed", *keys, F.col("score").alias("left_score"))
    theirs = predictions.where(F.col("model").isin(*variants)).select("seed", *keys, cluster, "target", F.col("model").alias("comparator"), F.col("score").alias("right_score"))
    deltas = paired(theirs.join(ours, ["seed", *keys]), "left_score", "right_score", 0, by=["seed", "comparator"], cluster=cluster)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("difference"))).alias(m + "_difference")
    return deltas.groupBy("seed", "comparator").agg(pick("auroc"), pick("auprc"), pick("brier"))


def stop_diagnosis(jobs: DataFrame) -> DataFrame:
    """Why training stopped, from iterations run, best iteration, cap and patience."""
    count, best, cap, patience = (F.col(c).cast("double") for c in ("iterations_run", "best_iteration", "cap", "patience"))
    done = jobs.withColumn("stale_iterations", count - best).withColumn("hit_cap", count >= cap).withColumn("patience_met", (count - best) >= patience)
    reason = (F.when(~F.col("complete"), "incomplete_or_running").when(count.isNull(), "uncollected").when(F.col("hit_cap"), "budget_cap")
              .when(F.col("patience_met"), "early_stopping").otherwise("unknown_stop"))
    return done.withColumn("stop_reason", reason)


def recent_gain(history: DataFrame, job: str = "job", window: int = RECENT_WINDOW, score: str = "score") -> DataFrame:
    """Best of the last iterations minus the best before them; NULL when there is nothing before.

    Only the last rows of a job are ranked (each task keeps that many), the rest is a plain maximum.
    """
    order = Window.partitionBy(job).orderBy(F.col("iteration").desc())
    last = history.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= window)
    recent = last.groupBy(job).agg(F.count(F.lit(1)).alias("recent_window"), F.min("iteration").alias("_from"), F.max(score).alias("_recent"), F.max_by(score, "iteration").alias("last_score"))
    before = history.join(recent.select(job, "_from"), job).where(F.col("iteration") < F.col("_from")).groupBy(job).agg(F.max(score).alias("_before"))
    return recent.join(before, job, "left").select(job, "recent_window", (F.col("_recent") - F.col("_before")).alias("recent_best_gain"), "last_score")


def history_rollup(history: DataFrame, job: str = "job", score: str = "score") -> DataFrame:
    """Iterations run and the best one: the first that no later one beats by more than the tolerance."""
    best = history.groupBy(job).agg(F.count(F.lit(1)).alias("iterations_run"), F.max(score).alias("best_score"), F.max_by(score, "iteration").alias("last_score"))
    first = history.join(best.select(job, "best_score"), job).where(F.col(score) > F.col("best_score") - IMPROVEMENT).groupBy(job).agg(F.min("iteration").alias("best_iteration"))
    return best.join(first, job)


def evidence_label(contrasts: DataFrame, profile: str = "full", low: str = "lo", high: str = "hi") -> DataFrame:
    """Reads an interval: positive, negative, inconclusive or not available; a mock run proves nothing."""
    label = (F.when(F.col(low).isNull() | F.col(high).isNull(), "not_available_or_suppressed").when(F.col(low) > 0, "positive_interval")
             .when(F.col(high) < 0, "negative_interval").otherwise("inconclusive_not_equivalent"))
    return contrasts.withColumn("evidence", F.lit("execution_test_only") if profile == "mock" else label)
