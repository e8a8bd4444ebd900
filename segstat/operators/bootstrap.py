"""Cluster bootstrap: exact draws with replacement, shared between models.

A replicate draws as many clusters as there are. The draws come from md5, so a
weight table is reproducible and can be reused for every model compared.
Rows are reduced to (cluster, score), and normal records to sums per cluster, before weights are
applied; all replicates of a sum travel together (``replicates``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import hash_below, keyed_md5, ratio
from ..plans.ordering import digest_index, null_safe_join, running_totals, spread, spread_large
from ..sources.scratch import materialize
from .metrics import auroc_of_curve, average_precision_of_curve, record_alarms, usable
from .replicates import pack_sorted, packed_weights, replicate_metrics

# Replicates of the small profile, and the interval's percentiles.
REPLICATES = 50
INTERVAL = (0.025, 0.975)
# Draws that one task makes or counts, so that its memory does not grow with the clusters.
DRAWS_PER_TASK = 2_000_000


def cluster_numbers(df: DataFrame, cluster: str = "cluster_id", seed: int = 42) -> DataFrame:
    """Distinct clusters numbered 0..M-1 in digest order, written once."""
    distinct = df.select(cluster).distinct().withColumn("_digest", keyed_md5(seed, F.col(cluster))).withColumn("_all", F.lit(1))
    return materialize(digest_index(materialize(distinct, "clusters"), ["_all"], "_digest", "number").select(cluster, "number"), "numbers")


def _drawn(numbers: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(b, number) of every draw: as many in each replicate as there are clusters.

    The numbers come out of one ordered task, so they are dealt before they are multiplied, a bounded count of draws to each task.
    """
    size = numbers.agg(F.count(F.lit(1))).scalar()
    dealt = spread(numbers.select("number"), numbers.count() * replicates, DRAWS_PER_TASK, "number")
    draws = dealt.select("number", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    return draws.select("b", hash_below(keyed_md5(seed, F.col("b"), F.col("number")), size).alias("number"))


def cluster_weights(df: DataFrame, replicates: int = REPLICATES, seed: int = 42, cluster: str = "cluster_id") -> DataFrame:
    """How often each replicate drew each cluster; clusters never drawn have no row."""
    numbers = cluster_numbers(df, cluster, seed)
    drawn = _drawn(numbers, replicates, seed)
    # All draws of a number meet in one task, which also holds its cluster: pairs are counted after that only exchange.
    dealt = spread(drawn, numbers.count() * replicates, DRAWS_PER_TASK, "number")
    counts = dealt.groupBy("number", "b").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(numbers, "number").select("b", cluster, "weight")


def packed_draws(df: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """The same draws with all replicates of a cluster in one row, for ``replicates.weighted_sums``."""
    numbers = cluster_numbers(df, "cluster_id", seed)
    drawn = _drawn(numbers, replicates, seed).select("number", "b", F.lit(1).alias("weight"))
    dealt = spread(drawn, numbers.count() * replicates, DRAWS_PER_TASK, "number")
    return pack_sorted(dealt, replicates).join(numbers, "number").select("cluster_id", "_w")


def reduce_scores(df: DataFrame, by: Sequence[str], alarm: Column | None = None, score: str = "score", target: str = "target",
                  cluster: str = "cluster_id") -> DataFrame:
    """Class and alarm counts per (by, cluster, score), written once: everything below reads only this.

    Rows that cannot be ranked are left out, as everywhere (``metrics.invalid_scores`` counts them).
    """
    y = F.col(target)
    a = F.lit(0) if alarm is None else F.coalesce(alarm.cast("int"), F.lit(0))
    return materialize(df.where(usable(score, target)).groupBy(*by, F.col(cluster).alias("cluster_id"), F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(y * a).alias("alarm_pos"), F.sum((1 - y) * a).alias("alarm_neg")), "reduced")


def reduce_normal_records(df: DataFrame, by: Sequence[str], alarm: Column, target: str = "target", record: str = "record_id",
                          cluster: str = "cluster_id", normal: Column | None = None) -> DataFrame:
    """Per (by, cluster): normal records, those alarmed, their segments and alarmed segments."""
    rolled = record_alarms(df, by, alarm, target, record, cluster, None, normal).where(F.col("normal") == 1)
    return rolled.groupBy(*by, F.col(cluster).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("normal_records"), F.count_if(F.col("alarms") > 0).alias("normal_alarmed"),
        F.sum("segments").alias("normal_segments"), F.sum("alarms").alias("normal_alarms"))


COUNTS = ("pos", "neg", "alarm_pos", "alarm_neg")


def score_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUROC, average precision and Brier score from counts per (keys, score); NULL where a class is absent."""
    totals = running_totals(cells, keys, "score", ["pos", "neg"], descending=True)
    curve = totals.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "total_pos": "p", "total_neg": "n"})
    error = F.col("pos") * F.pow(F.col("score") - 1, 2) + F.col("neg") * F.pow(F.col("score"), 2)
    summed = curve.groupBy(*keys).agg(auroc_of_curve().alias("auroc"), average_precision_of_curve().alias("auprc"), F.sum(error).alias("_error"),
                                      F.max("p").alias("_p"), F.max("n").alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    columns = {"auroc": F.col("auroc"), "auprc": F.col("auprc"), "brier": ratio(F.col("_error"), p + n)}
    return summed.select(*keys, *[F.when((p > 0) & (n > 0), c).alias(name) for name, c in columns.items()])


def _long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    metrics = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))).where(F.col("value").isNotNull())


def bootstrap_ci(df: DataFrame, by: Sequence[str], replicates: int = REPLICATES, seed: int = 42, alarm: Column | None = None,
                 weights: DataFrame | None = None, record: str | None = None, normal: Column | None = None, **names: str) -> DataFrame:
    """Percentile interval and number of valid replicates per metric.

    With ``alarm`` the operating metrics are added, with ``record`` those of normal records too.
    """
    if not record or alarm is None:
        reduced, records = reduce_scores(df, by, alarm, **names), None
    else:
        score, target, cluster = (names.get(k, v) for k, v in (("score", "score"), ("target", "target"), ("cluster", "cluster_id")))
        extra = [] if normal is None else [normal.cast("int").alias("_normal")]
        # Two reductions read these rows: they are joined and computed once.
        rows = materialize(df.select(*by, *dict.fromkeys([score, target, cluster, record]), alarm.alias("_alarm"), *extra), "alarmed")
        count = rows.count()
        reduced = reduce_scores(spread_large(rows, count, cluster, score), by, F.col("_alarm"), score, target, cluster)
        records = reduce_normal_records(spread_large(rows, count, cluster, record), by, F.col("_alarm"), target, record, cluster, None if normal is None else F.col("_normal"))
    drawn, width = _draws_of(reduced, replicates, seed, weights)
    return intervals(_long(replicate_metrics(reduced, records, drawn, width, by, alarm is not None), [*by, "b"]), by)


def _draws_of(reduced: DataFrame, replicates: int, seed: int, weights: DataFrame | None) -> tuple[DataFrame, int]:
    """One row of draws for each cluster, written once, and the number of replicates."""
    if weights is None:
        return materialize(packed_draws(reduced, replicates, seed), "draws"), replicates
    width = (weights.agg(F.max("b")).first()[0] or 0) + 1
    return materialize(packed_weights(weights, width), "draws"), width


def intervals(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percentile interval and count per metric; a group holds at most one value for each replicate."""
    ends = values.groupBy(*by, "metric").agg(F.percentile("value", F.array(*[F.lit(p) for p in INTERVAL])).alias("_q"), F.count("value").alias("n_valid"))
    return ends.select(*by, "metric", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), "n_valid")


def paired(df: DataFrame, left: str, right: str, replicates: int = REPLICATES, seed: int = 42, weights: DataFrame | None = None,
           by: Sequence[str] = (), target: str = "target", cluster: str = "cluster_id") -> DataFrame:
    """Left minus right for AUROC, average precision and Brier on the same rows and the same draws.

    With ``replicates`` 0 only the point difference is given.
    """
    arms = F.array(F.struct(F.lit("left").alias("arm"), F.col(left).alias("score")), F.struct(F.lit("right").alias("arm"), F.col(right).alias("score")))
    keys = ["arm", *by]
    rows = materialize(df.select(*by, cluster, target, F.inline(arms)), "arms")
    reduced = reduce_scores(spread_large(rows, rows.count(), cluster, "score"), keys, None, "score", target, cluster)
    cells = reduced.groupBy(*keys, "score").agg(*[F.sum(c).alias(c) for c in COUNTS])
    point = _left_minus_right(_long(score_metrics(cells, keys), keys), by, "difference")
    if not replicates:
        return point.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("n_valid", F.lit(0).cast("bigint"))
    drawn, width = _draws_of(reduced, replicates, seed, weights)
    values = _long(replicate_metrics(reduced, None, drawn, width, keys, False), [*keys, "b"])
    deltas = _left_minus_right(values, ["b", *by], "value").where(F.col("value").isNotNull())
    return null_safe_join(point, intervals(deltas, by), [*by, "metric"], "left")


def _left_minus_right(values: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    kept = values.where(F.col("metric").isin("auroc", "auprc", "brier"))
    return kept.groupBy(*by, "metric").agg((side("left") - side("right")).alias(name))
