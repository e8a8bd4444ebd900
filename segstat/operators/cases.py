"""Contributions, feature responses, case review and box scores."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import ratio
from ..plans.ordering import average_ranks, exact_quantiles, null_safe_join, value_counts
from ..sources.scratch import materialize
from .metrics import at_or_above

CATEGORIES = ("TP", "TN", "FP", "FN")
TOP_CONTRIBUTORS = 5


def mean_abs_contribution(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature with its rank; the feature list is short."""
    means = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_abs_contribution").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order))


def binned(df: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Adds the quantile bin of a value: repeated edges merge, bins are closed on the right."""
    inner = [k / bins for k in range(0, bins + 1)]
    names = [f"_e{k}" for k in range(bins + 1)]
    # A written table has a known, tiny size (a row per feature), so the rows are not shuffled to meet it.
    edges = materialize(exact_quantiles(df, by, value, inner, names).select(*by, F.array_distinct(F.array(*names)).alias("_edges")), "edges")
    joined = null_safe_join(df, edges, by)
    middle = F.when(F.size("_edges") > 2, F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    v = F.col(value)
    return joined.withColumn("_middle", middle).withColumn("bin", F.size(F.filter("_middle", lambda e: e < v)).cast("int")).drop("_middle")


def contribution_direction(contributions: DataFrame, quantiles: int = 4, cluster: str = "cluster_id") -> DataFrame:
    """Mean contribution per quartile of the feature's value, with contributing clusters."""
    labelled = binned(contributions.where(F.col("value").isNotNull()), ["feature"], "value", quantiles)
    per_cluster = labelled.where(F.col("contribution").isNotNull()).groupBy("feature", "bin", cluster).agg(F.count(F.lit(1)).alias("c"), F.sum("contribution").alias("s"))
    return per_cluster.groupBy("feature", "bin").agg(F.sum("c").alias("segments"), F.count(F.lit(1)).alias("clusters"), ratio(F.sum("s"), F.sum("c")).alias("mean_contribution"))


def value_rank(contributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentile rank of each value within its feature, ties averaged."""
    ranks = average_ranks(value_counts(contributions, ["feature"], "value"), ["feature"], "value")
    joined = null_safe_join(contributions, ranks.select("feature", "value", (F.col("rank") / F.col("group_rows")).alias("percentile_rank")), ["feature", "value"])
    return joined.select(*keys, "feature", "percentile_rank")


def feature_response(long: DataFrame, bins: int = 8, cluster: str = "cluster_id") -> DataFrame:
    """Training rows by quantile bin of each feature: counts, clusters and positive fraction."""
    labelled = binned(long, ["feature"], "value", bins)
    last = F.size("_edges")
    ranged = labelled.withColumn("lower", F.get("_edges", F.col("bin"))).withColumn("upper", F.get("_edges", F.least(F.col("bin") + 1, last - 1)))
    keys = ["feature", "bin", "lower", "upper"]
    per_cluster = ranged.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("c"), F.sum("target").alias("p"))
    return per_cluster.groupBy(*keys).agg(
        F.sum("c").alias("n_segments"), F.count(F.lit(1)).alias("clusters"), F.sum("p").alias("n_positive"), F.count_if(F.col("p") > 0).alias("positive_clusters"),
        F.count_if(F.col("c") > F.col("p")).alias("negative_clusters"), ratio(F.sum("p"), F.sum("c")).alias("positive_fraction"))


def top_contributors(contributions: DataFrame, keys: Sequence[str], k: int = TOP_CONTRIBUTORS) -> DataFrame:
    """The k largest finite contributions of each row, by magnitude then feature."""
    known = contributions.where(F.col("contribution").isNotNull() & ~F.isnan("contribution"))
    order = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def case_category(predictions: DataFrame, alarm=None) -> DataFrame:
    """TP / TN / FP / FN at the fixed threshold; a score on the threshold alarms."""
    raised = at_or_above() if alarm is None else alarm
    category = F.when(F.col("target") == 1, F.when(raised, "TP").otherwise("FN")).otherwise(F.when(raised, "FP").otherwise("TN"))
    return predictions.withColumn("category", category)


def extreme_cases(predictions: DataFrame, per_category: int = 2, keys: Sequence[str] = ("record_id", "seg_idx")) -> DataFrame:
    """The most extreme cases of each category: highest scores for TP/FP, lowest for FN/TN.

    Ties go to the smaller key. Each task forwards only its own candidates.
    """
    labelled = case_category(predictions)
    severity = F.when(F.col("category").isin("FN", "TN"), F.col("score")).otherwise(-F.col("score"))
    order = Window.partitionBy("category").orderBy("_severity", *keys)
    return (labelled.withColumn("_severity", severity).withColumn("case_number", F.row_number().over(order))
            .where(F.col("case_number") <= per_category).drop("_severity"))


def case_signals(cases: DataFrame, segments: DataFrame, keys: Sequence[str] = ("record_id", "seg_idx")) -> DataFrame:
    """Segments of the selected cases by key, reporting cases that are absent or disagree on the target."""
    source = segments.withColumnRenamed("target", "_target").withColumn("_found", F.lit(True))
    joined = cases.join(source, list(keys), "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("target") != F.col("_target"), "target_mismatch").otherwise("ok")
    return joined.withColumn("alignment", status).drop("_found", "_target")


def box_segment_score(boxes: DataFrame, dims: DataFrame, record: str = "record_id") -> DataFrame:
    """Largest confidence per segment by box centre; the right edge belongs to the last; no box scores 0.

    dims: record, width, n_segments.
    """
    joined = boxes.join(dims, record)
    centre = F.least(F.greatest((F.col("x1") + F.col("x2")) / 2, F.lit(0.0)), F.col("width").cast("double"))
    index = F.least(F.floor(centre / F.col("width") * F.col("n_segments")), F.col("n_segments") - 1)
    best = joined.groupBy(record, index.alias("seg_idx")).agg(F.max("confidence").alias("_score"))
    grid = dims.select(record, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_segments") - 1)).alias("seg_idx"))
    return grid.join(best, [record, "seg_idx"], "left").select(record, "seg_idx", F.coalesce("_score", F.lit(0.0)).alias("score"))


# Detector limits.
NMS_CONFIDENCE, NMS_IOU, NMS_MAX = 0.001, 0.6, 300


def nms(boxes: DataFrame, image: str = "record_id", confidence: float = NMS_CONFIDENCE, iou: float = NMS_IOU, max_det: int = NMS_MAX) -> DataFrame:
    """Greedy single-class suppression per image: boxes cx, cy, w, h, obj, cls to x1..y2, score.

    Boxes are taken from the highest score down (then box_no) and kept unless a
    kept one overlaps by more than the limit; at most max_det are kept. An
    image's boxes are bounded by the detector's grid, so its array is small.
    """
    scored = boxes.withColumn("score", F.col("obj") * F.col("cls")).where(F.col("score") > confidence).select(image, F.struct(
        (-F.col("score")).alias("rank"), "box_no", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"),
        (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2")).alias("box"))
    ordered = scored.groupBy(image).agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    area = lambda b: side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])

    def overlaps(a, b):
        shared = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
        return shared / F.greatest(area(a) + area(b) - shared, F.lit(1e-12)) > iou

    nothing = F.filter("boxes", lambda b: F.lit(False))
    kept = F.aggregate("boxes", nothing, lambda kept, b: F.when(
        (F.size(kept) >= max_det) | F.exists(kept, lambda a: overlaps(a, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return ordered.select(image, F.inline(kept)).withColumn("score", -F.col("rank")).drop("rank")
