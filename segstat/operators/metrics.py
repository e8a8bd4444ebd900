"""Ranking metrics, operating points, calibration and grouped evaluation.

Everything starts from small aggregates: rows are first reduced to one row per
distinct score (ranking) and one row per record (alarms), with map-side
combining, so a group holding most of the rows costs no more than the others.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ratio
from ..plans.ordering import average_ranks, null_safe_join, running_totals
from ..sources.scratch import materialize

# Specificity aimed at, tolerance on its complement, 5-minute segments per hour.
SPECIFICITY = 0.9
SPECIFICITY_SLACK = 1e-12
SEGMENTS_PER_HOUR = 12


def score_curve(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target",
                weight: Column | None = None) -> DataFrame:
    """One row per (by, distinct score): pos, neg, running tp/fp from the top, totals p/n.

    Rows without a finite score or a target are left out; ``invalid_scores`` counts them.
    """
    kept = df.where(usable(score, target))
    y = F.col(target)
    w = F.lit(1) if weight is None else weight
    kind = kept.select((w * y).alias("w")).schema["w"].dataType.typeName()
    # Whole weights add up exactly; fractional ones stay fractions.
    total = "double" if kind in ("double", "float") or kind.startswith("decimal") else "bigint"
    points = kept.groupBy(*by, score).agg(F.sum(w * y).cast(total).alias("pos"), F.sum(w * (1 - y)).cast(total).alias("neg"))
    totals = running_totals(points, by, score, ["pos", "neg"], descending=True)
    return totals.select(*by, score, "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                         F.col("total_pos").alias("p"), F.col("total_neg").alias("n"))


def usable(score: str, target: str) -> Column:
    value = F.col(score).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & F.col(target).isNotNull()


def invalid_scores(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    """Rows, and rows that cannot be ranked (score missing or not finite, or target missing), per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~usable(score, target)).alias("invalid_rows"))


def auroc_of_curve() -> Column:
    """Trapezoid over distinct scores: each negative beats-by-half its ties."""
    return ratio(F.sum(F.col("neg") * (F.col("tp") * 2 - F.col("pos")) / 2), F.max("p").cast("double") * F.max("n"))


def average_precision_of_curve() -> Column:
    return ratio(F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), F.max("p"))


def sensitivity_at_of_curve(specificity: float = SPECIFICITY) -> Column:
    inside = ratio(F.col("fp"), F.col("n")) <= (1 - specificity) + SPECIFICITY_SLACK
    return F.coalesce(F.max(F.when(inside, ratio(F.col("tp"), F.col("p")))),
                      F.when((F.max("p") > 0) & (F.max("n") > 0), F.lit(0.0)))


def auroc(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target", weight: Column | None = None) -> DataFrame:
    return score_curve(df, by, score, target, weight).groupBy(*by).agg(auroc_of_curve().alias("auroc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target", weight: Column | None = None) -> DataFrame:
    return score_curve(df, by, score, target, weight).groupBy(*by).agg(average_precision_of_curve().alias("auprc"))


def sens_at_spec(df: DataFrame, by: Sequence[str], specificity: float = SPECIFICITY, score: str = "score", target: str = "target") -> DataFrame:
    return score_curve(df, by, score, target).groupBy(*by).agg(
        sensitivity_at_of_curve(specificity).alias("sensitivity_at_spec90"))


def ranking(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target", weight: Column | None = None) -> DataFrame:
    """AUROC, average precision and sensitivity at the aimed specificity in one pass."""
    return score_curve(df, by, score, target, weight).groupBy(*by).agg(
        auroc_of_curve().alias("auroc"), average_precision_of_curve().alias("auprc"),
        sensitivity_at_of_curve().alias("sensitivity_at_spec90"))


def threshold90(df: DataFrame, by: Sequence[str], specificity: float = SPECIFICITY, score: str = "score", target: str = "target", weight: Column | None = None) -> DataFrame:
    """Score that alarms must exceed strictly so that at least 90 % of negatives stay quiet."""
    below = F.col("n") - F.col("fp") + F.col("neg")
    reached = (F.col("neg") > 0) & (below >= F.ceil(F.lit(float(specificity)) * F.col("n")))
    return score_curve(df, by, score, target, weight).groupBy(*by).agg(
        F.when((F.max("p") > 0) & (F.max("n") > 0), F.min(F.when(reached, F.col(score)))).alias("alarm_above"))


def at_or_above(threshold: str | float = "threshold", score: str = "score") -> Column:
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return F.col(score) >= limit


def operating_point(df: DataFrame, by: Sequence[str], alarm: Column, target: str = "target") -> DataFrame:
    y, a = F.col(target), alarm.cast("int")
    return df.groupBy(*by).agg(
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"), F.sum(y * a).alias("_tp"), F.sum((1 - y) * a).alias("_fp"),
    ).select(*by, *_operating_columns("_p", "_n", "_tp", "_fp"))


def _operating_columns(p: str, n: str, tp: str, fp: str) -> list[Column]:
    p_, n_, tp_, fp_ = F.col(p), F.col(n), F.col(tp), F.col(fp)
    return [
        ratio(tp_, p_).alias("sensitivity"),
        (1 - ratio(fp_, n_)).alias("specificity"),
        ratio(tp_, tp_ + fp_).alias("ppv"),
        ratio(tp_ * 2, p_ + tp_ + fp_).alias("f1"),
        ratio(p_, p_ + n_).alias("prevalence"),
    ]


def brier(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(target), 2)).alias("brier"))


def accuracy(df: DataFrame, by: Sequence[str], threshold: float = 0.5, score: str = "score", target: str = "target") -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int") == F.col(target)
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("accuracy"))


def record_alarms(df: DataFrame, by: Sequence[str], alarm: Column, target: str = "target",
                  record: str = "record_id", cluster: str = "cluster_id", score: str | None = None,
                  normal: Column | None = None) -> DataFrame:
    """One row per (by, cluster, record): counts and whether the record is all normal.

    ``normal`` takes a given all-normal flag (e.g. known from excluded segments too)."""
    y, a = F.col(target), alarm.cast("int")
    extra = [F.sum(F.pow(F.col(score) - y, 2)).alias("sqerr")] if score else []
    is_normal = (F.max(y) == 0) if normal is None else F.max(normal.cast("int")) == 1
    return df.groupBy(*by, cluster, record).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(y).alias("pos"), F.sum(y * a).alias("tp"),
        F.sum((1 - y) * a).alias("fp"), F.sum(a).alias("alarms"), is_normal.cast("int").alias("normal"), *extra)


def normal_record_alarm_rate(df: DataFrame, by: Sequence[str], alarm: Column, **names: str) -> DataFrame:
    """Share of all-normal records with any alarmed segment."""
    rolled = record_alarms(df, by, alarm, **names)
    return rolled.where(F.col("normal") == 1).groupBy(*by).agg(
        F.count(F.lit(1)).alias("normal_records"), F.count_if(F.col("alarms") > 0).alias("normal_records_alarmed"),
        F.avg((F.col("alarms") > 0).cast("double")).alias("normal_record_alarm_rate"))


def false_alarms_per_hour(df: DataFrame, by: Sequence[str], alarm: Column, **names: str) -> DataFrame:
    rolled = record_alarms(df, by, alarm, **names)
    return rolled.where(F.col("normal") == 1).groupBy(*by).agg(
        ratio(F.sum("alarms"), F.sum("segments") / SEGMENTS_PER_HOUR).alias("false_alarms_per_normal_hour"))


def cohort_counts(df: DataFrame, by: Sequence[str], target: str = "target", cluster: str = "cluster_id") -> DataFrame:
    """Rows, clusters, positives and clusters per class (a cluster may be in both)."""
    per_cluster = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("rows"), F.sum(target).alias("pos"))
    return per_cluster.groupBy(*by).agg(
        F.sum("rows").alias("n"), F.count(cluster).alias("clusters"), F.sum("pos").alias("positives"),
        F.count_if((F.col("pos") > 0) & F.col(cluster).isNotNull()).alias("positive_clusters"),
        F.count_if((F.col("rows") > F.col("pos")) & F.col(cluster).isNotNull()).alias("negative_clusters"))


EVALUATION_METRICS = ["auroc", "auprc", "prevalence", "sensitivity_at_spec90", "sensitivity", "specificity", "ppv",
                      "f1", "brier", "normal_record_alarm_rate", "false_alarms_per_normal_hour"]


def evaluate(df: DataFrame, by: Sequence[str], alarm: Column, *, score: str = "score", target: str = "target",
             record: str = "record_id", cluster: str = "cluster_id", normal: Column | None = None) -> DataFrame:
    """Status, cohort counts and every point metric, one row per group.

    Groups with a single class keep their counts and get NULL metrics.
    """
    per_record = record_alarms(df, by, alarm, target, record, cluster, score, normal)
    is_normal = F.col("normal")
    per_cluster = per_record.groupBy(*by, cluster).agg(
        *[F.sum(c).alias(c) for c in ("segments", "pos", "tp", "fp", "sqerr")],
        F.sum(is_normal).alias("normal_records"),
        F.sum(is_normal * (F.col("alarms") > 0).cast("int")).alias("normal_alarmed"),
        F.sum(is_normal * F.col("segments")).alias("normal_segments"),
        F.sum(is_normal * F.col("alarms")).alias("normal_alarms"))
    group = per_cluster.groupBy(*by).agg(
        F.sum("segments").alias("n"), F.count(cluster).alias("clusters"), F.sum("pos").alias("positives"),
        F.count_if(F.col("pos") > 0).alias("positive_clusters"), F.count_if(F.col("segments") > F.col("pos")).alias("negative_clusters"),
        F.count_if(F.col("normal_records") > 0).alias("normal_clusters"),
        F.count_if(F.col("normal_alarms") > 0).alias("normal_alarm_clusters"),
        *[F.sum(c).alias("_" + c) for c in ("tp", "fp", "sqerr", "normal_records", "normal_alarmed", "normal_segments", "normal_alarms")],
    ).withColumn("_neg", F.col("n") - F.col("positives"))
    curve = ranking(df, by, score, target)
    joined = null_safe_join(group, curve, by)
    two = (F.col("positives") > 0) & (F.col("_neg") > 0)
    metrics = {
        "auroc": F.col("auroc"), "auprc": F.col("auprc"), "sensitivity_at_spec90": F.col("sensitivity_at_spec90"),
        "prevalence": ratio(F.col("positives"), F.col("n")),
        "sensitivity": ratio(F.col("_tp"), F.col("positives")),
        "specificity": 1 - ratio(F.col("_fp"), F.col("_neg")),
        "ppv": ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")),
        "f1": ratio(F.col("_tp") * 2, F.col("positives") + F.col("_tp") + F.col("_fp")),
        "brier": ratio(F.col("_sqerr"), F.col("n")),
        "normal_record_alarm_rate": ratio(F.col("_normal_alarmed"), F.col("_normal_records")),
        "false_alarms_per_normal_hour": ratio(F.col("_normal_alarms"), F.col("_normal_segments") / SEGMENTS_PER_HOUR),
    }
    return joined.select(
        *by, F.when(two, "ok").otherwise("insufficient_classes").alias("status"),
        "n", "clusters", "positives", "positive_clusters", "negative_clusters", "normal_clusters", "normal_alarm_clusters",
        (F.col("normal_clusters") - F.col("normal_alarm_clusters")).alias("normal_quiet_clusters"),
        *[F.when(two, metrics[m]).alias(m) for m in EVALUATION_METRICS])


def explode_subgroups(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One copy of a row per predefined subgroup it belongs to; subgroups may overlap."""
    names = F.filter(F.array(*[F.when(mask, F.lit(name)) for name, mask in masks.items()]), lambda v: v.isNotNull())
    return df.withColumn("subgroup", F.explode(names))


def evaluate_by(df: DataFrame, masks: dict[str, Column], by: Sequence[str], alarm: Column, **names) -> DataFrame:
    return evaluate(explode_subgroups(df, masks), ["subgroup", *by], alarm, **names)


def roc_points(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    return score_curve(df, by, score, target).select(*by, score, ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))


def pr_points(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    return score_curve(df, by, score, target).select(
        *by, score, ratio(F.col("tp"), F.col("p")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_grid(df: DataFrame, by: Sequence[str], steps: int = 20, score: str = "score", target: str = "target") -> DataFrame:
    """ROC/PR values on steps+1 fixed thresholds.

    A row counts towards every threshold at or below its score, so rows are
    first reduced to the highest threshold they reach, then summed downwards.
    """
    y = F.col(target)
    # The highest k with k / steps <= score, judged by the same division the thresholds use.
    guess = F.floor(F.col(score) * steps)
    reached = F.when((guess + 1) / F.lit(float(steps)) <= F.col(score), guess + 1).when(
        guess / F.lit(float(steps)) > F.col(score), guess - 1).otherwise(guess)
    level = F.least(F.greatest(reached, F.lit(-1)), F.lit(steps)).cast("int")
    counted = df.groupBy(*by, level.alias("_level")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cells = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = F.col("_level") >= F.col("k")
    summed = cells.groupBy(*by, "k").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"))
    return summed.select(*by, (F.col("k") / F.lit(float(steps))).alias("threshold"),
                         ratio(F.col("fp"), F.col("_n")).alias("fpr"), ratio(F.col("tp"), F.col("_p")).alias("recall"),
                         ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def score_bin(bins: int, score: str = "score") -> Column:
    """Equal-width bins on [0, 1], the last one closed; edges judged as k / bins."""
    guess = F.floor(F.col(score) * bins)
    edge = F.lit(float(bins))
    exact = F.when((guess + 1) / edge <= F.col(score), guess + 1).when(guess / edge > F.col(score), guess - 1).otherwise(guess)
    return F.least(exact, F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, by: Sequence[str], bins: int = 10, score: str = "score", target: str = "target") -> DataFrame:
    return df.groupBy(*by, score_bin(bins, score).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_prediction"), F.avg(F.col(target).cast("double")).alias("observed"))


def full_grid(df: DataFrame, by: Sequence[str], cells: dict[str, Sequence[int]]) -> DataFrame:
    """Every combination of the fixed cell values for each group present."""
    grid = df.select(*by).distinct()
    for name, values in cells.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def confusion(df: DataFrame, by: Sequence[str], alarm: Column, target: str = "target", cluster: str = "cluster_id") -> DataFrame:
    """Segments and distinct clusters in each of the four cells; empty cells are kept."""
    cells = df.select(*by, cluster, F.col(target).alias("actual"), alarm.cast("int").alias("predicted"))
    per_cluster = cells.groupBy(*by, "actual", "predicted", cluster).agg(F.count(F.lit(1)).alias("segments"))
    counts = per_cluster.groupBy(*by, "actual", "predicted").agg(F.sum("segments").alias("segments"), F.count(cluster).alias("clusters"))
    grid = full_grid(counts, by, {"actual": [0, 1], "predicted": [0, 1]})
    return null_safe_join(grid, counts, [*by, "actual", "predicted"], "left").fillna(0, ["segments", "clusters"])


def score_hist(df: DataFrame, by: Sequence[str], bins: int = 20, score: str = "score", target: str = "target") -> DataFrame:
    """Counts per bin and class, and each bin's share of its class."""
    counts = df.groupBy(*by, F.col(target).alias("actual"), score_bin(bins, score).alias("bin")).agg(F.count(F.lit(1)).alias("segments"))
    share = Window.partitionBy(*by, "actual")
    return counts.withColumn("class_fraction", ratio(F.col("segments"), F.sum("segments").over(share)))


def mann_whitney_auroc(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    """AUROC from average ranks: an independent formulation of the same number."""
    points = materialize(df.groupBy(*by, score).agg(F.sum(target).alias("_pos"), F.count(F.lit(1)).alias("n")), "points")
    joined = null_safe_join(points.withColumnRenamed("n", "_all"), average_ranks(points, by, score).drop("n"), [*by, score])
    p, n = F.sum("_pos"), F.sum(F.col("_all") - F.col("_pos"))
    return joined.groupBy(*by).agg(
        ratio(F.sum(F.col("rank") * F.col("_pos")) - p * (p + 1) / 2, p.cast("double") * n).alias("auroc_check"))


def verify_metrics(df: DataFrame, stored: DataFrame, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Recomputes AUROC and average precision; ``matches`` is false where a stored value differs or is missing."""
    fresh = null_safe_join(mann_whitney_auroc(df, by), average_precision(df, by).withColumnRenamed("auprc", "auprc_check"), by)
    joined = null_safe_join(stored.select(*by, "auroc", "auprc"), fresh, by, "full")
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return joined.withColumn("matches", close("auroc", "auroc_check") & close("auprc", "auprc_check"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; NULL when either side is constant."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = materialize(complete.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w")), "pairs")
    counts = lambda c: pairs.groupBy(*by, c).agg(F.sum("_w").alias("n"))
    rx = average_ranks(counts(x), by, x, "_rx").select(*by, x, "_rx")
    ry = average_ranks(counts(y), by, y, "_ry").select(*by, y, "_ry")
    ranked = null_safe_join(null_safe_join(pairs, rx, [*by, x]), ry, [*by, y])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("pairs"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
        F.min(a).alias("la"), F.max(a).alias("ha"), F.min(b).alias("lb"), F.max(b).alias("hb"))
    n = F.col("pairs")
    rho = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / n,
                       F.sqrt(F.col("saa") - F.col("sa") * F.col("sa") / n) * F.sqrt(F.col("sbb") - F.col("sb") * F.col("sb") / n))
    varied = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    return sums.select(*by, F.col("pairs").alias("n"), F.when(varied, rho).alias("spearman"))


def mae(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(x) - F.col(y))).alias("mae"))


def reverse_contrast(df: DataFrame, estimate: str = "difference", low: str = "lo", high: str = "hi",
                     left: str = "left_model", right: str = "right_model") -> DataFrame:
    """The same contrast seen from the other side: sign and interval ends swap."""
    swap = {estimate: -F.col(estimate), low: -F.col(high), high: -F.col(low), left: F.col(right), right: F.col(left)}
    return df.select(*[swap.get(c, F.col(c)).alias(c) for c in df.columns])
