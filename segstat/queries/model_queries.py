"""Fitted models (H1-H5, H11, H13) and what is evaluated from them (I7, I8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M, models as T, outcomes as O, signal as C, splits as S
from ..sources import bindings as B
from ..sources.scratch import materialize
from .metric_queries import rounded
from .registry import query
from .signal_queries import TRAIN, train_clusters

FEATURES = B.SEGMENT_FEATURES
SEG = ["record_id", "seg_idx"]


def split_segments(spark, d):
    """Segments with their split, written once: every fit reads them several times."""
    rows = materialize(B.segments(spark, d).select(*SEG, "cluster_id", "target", *FEATURES), "segments")
    assigned = S.assign(rows, S.holdout_split(rows, test_folds=5, validation_folds=4))
    return {name: assigned.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}


@query("H01_logistic_scores")
def logistic_scores(spark, d):
    parts = split_segments(spark, d)
    model = T.logistic(parts["train"], FEATURES)
    return rounded(T.predict(model, parts["test"]).select(*SEG, "target", "score"), "score")


@query("H02_single_feature_scan")
def single_feature_scan(spark, d):
    parts = split_segments(spark, d)
    return rounded(T.single_feature_scan(parts["train"], parts["val"], FEATURES), "validation_auroc")


SPLINE_RANGE = "(SELECT min(y_mean) AS lo, max(y_mean) AS hi FROM segments WHERE cluster_id IN (SELECT cluster_id FROM train))"
SPLINE_COLUMNS = ", ".join(
    f"""round(CASE WHEN u + 3 - {j} < 0 OR u + 3 - {j} >= 4 THEN 0 WHEN u + 3 - {j} < 1 THEN power(u + 3 - {j}, 3) / 6 WHEN u + 3 - {j} < 2 THEN (-3 * power(u + 3 - {j}, 3) + 12 * power(u + 3 - {j}, 2) - 12 * (u + 3 - {j}) + 4) / 6
 WHEN u + 3 - {j} < 3 THEN (3 * power(u + 3 - {j}, 3) - 24 * power(u + 3 - {j}, 2) + 60 * (u + 3 - {j}) - 44) / 6 ELSE power(1 - u + {j}, 3) / 6 END::DOUBLE, 6) AS y_mean_s{j}""" for j in range(6))


@query("H03_spline_basis", f"""WITH {TRAIN}, r AS {SPLINE_RANGE}, v AS (SELECT record_id, seg_idx, (least(greatest(y_mean, lo), hi) - lo) / ((hi - lo) / 4) AS u FROM segments CROSS JOIN r) SELECT record_id, seg_idx, {SPLINE_COLUMNS} FROM v""")
def spline_basis(spark, d):
    rows = B.segments(spark, d)
    low, high = T.spline_bounds(rows.join(train_clusters(spark, d), "cluster_id", "left_semi"), ["y_mean"])["y_mean"]
    out, names = T.spline_basis(rows, "y_mean", low, high)
    return rounded(out.select(*SEG, *names), *names)


@query("H03_spline_feature_scan")
def spline_scan(spark, d):
    parts = split_segments(spark, d)
    return rounded(T.single_feature_scan(parts["train"], parts["val"], FEATURES, "nonlinear_spline"), "validation_auroc")


@query("H04_boosted_trees")
def boosted_trees(spark, d):
    parts = split_segments(spark, d)
    model = T.boosted_trees(parts["train"], parts["val"], FEATURES, 42, iterations=30, depth=6)
    return rounded(T.predict(model, parts["test"]).select(*SEG, "target", "score"), "score")


@query("H05_out_of_fold_scores")
def out_of_fold(spark, d):
    rows = materialize(B.segments(spark, d).select(*SEG, "cluster_id", "target", *FEATURES), "segments")
    folds = materialize(S.nested_folds(rows, 3, 4, 42), "folds")
    oof = T.oof_predict(rows, folds, lambda fit, tune: T.logistic(fit, FEATURES))
    return rounded(oof.select(*SEG, "target", "fold", "score", "alarm_above"), "score", "alarm_above")


def out_of_fold_metrics(spark, d):
    rows = materialize(B.segments(spark, d).select(*SEG, "cluster_id", "target", *FEATURES), "segments")
    folds = materialize(S.nested_folds(rows, 3, 4, 42), "folds")
    oof = materialize(T.oof_predict(rows, folds, lambda fit, tune: T.logistic(fit, FEATURES)), "oof")
    return T.oof_metrics(rows, oof.withColumn("arm", F.lit("logistic")), SEG, ["arm"])


@query("H05_out_of_fold_metrics")
def pooled_metrics(spark, d):
    return rounded(out_of_fold_metrics(spark, d), *M.EVALUATION_METRICS)


@query("H05_coverage", "SELECT 'logistic' AS arm, count(*) AS expected, count(*) AS scored, 'ok' AS status, count(*) AS n, count(DISTINCT cluster_id) AS clusters, CAST(sum(target) AS BIGINT) AS positives FROM segments")
def coverage(spark, d):
    """Every segment is scored by exactly one fold, so the pooled metrics stand on the whole cohort."""
    return out_of_fold_metrics(spark, d).select("arm", "expected", "scored", "status", "n", "clusters", "positives")


HELD_SITE = 3


def site_roles(spark, d):
    rows = materialize(B.scored(spark, d).select("record_id", "cluster_id", "site", "target", F.col("m1").alias("score")), "scored")
    return T.transfer_roles(rows, F.col("site") == HELD_SITE)


@query("H11_platt_recalibration")
def platt(spark, d):
    """Fitted on source validation rows, with the alarm limits of both arms chosen again there."""
    moved, slope = T.transfer(materialize(site_roles(spark, d), "roles"))
    return rounded(moved.withColumn("monotone_increasing", F.lit(slope > 0)), "score", "alarm_above")


@query("H11_transfer_roles", f"""WITH held AS (SELECT DISTINCT cluster_id FROM predictions WHERE site = {HELD_SITE}), source AS (SELECT * FROM predictions WHERE site <> {HELD_SITE} AND cluster_id NOT IN (SELECT cluster_id FROM held)),
strata AS (SELECT cluster_id, max(target) AS stratum FROM source GROUP BY 1),
folds AS (SELECT cluster_id, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || cluster_id)) - 1) % 5 AS fold FROM strata),
roled AS (SELECT s.cluster_id, target, CASE WHEN fold = 0 THEN 'validation' ELSE 'fit' END AS role FROM source s JOIN folds USING (cluster_id) UNION ALL SELECT cluster_id, target, 'held' FROM predictions WHERE site = {HELD_SITE})
SELECT role, count(*) AS n, count(DISTINCT cluster_id) AS clusters, CAST(sum(target) AS BIGINT) AS positives FROM roled GROUP BY role""")
def transfer_roles(spark, d):
    per_cluster = site_roles(spark, d).groupBy("role", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p"))
    return per_cluster.groupBy("role").agg(F.sum("n").alias("n"), F.count("cluster_id").alias("clusters"), F.sum("p").alias("positives"))


@query("H01_training_medians", f"""WITH {TRAIN} SELECT c AS feature, quantile_cont(v, 0.5) AS median FROM (SELECT unnest({FEATURES}) AS c, unnest([{", ".join(FEATURES)}]) AS v FROM segments WHERE cluster_id IN (SELECT cluster_id FROM train)) GROUP BY c""")
def training_medians(spark, d):
    """What the pipeline fills missing values with."""
    rows = B.segments(spark, d).join(train_clusters(spark, d), "cluster_id", "left_semi")
    medians = T.exact_medians(rows, FEATURES)
    return spark.createDataFrame(list(medians.items()), "feature string, median double")


@query("H13_linear_contributions")
def linear_contributions(spark, d):
    parts = split_segments(spark, d)
    model = T.logistic(parts["train"], FEATURES)
    return rounded(T.linear_contributions(model, parts["test"], FEATURES, SEG), "value", "contribution")


@query("I07_incremental_value")
def incremental_value(spark, d):
    rows = B.records(spark, d).where(F.col("balance") >= 0).select(
        "record_id", "cluster_id", (F.col("balance") < 2000).cast("int").alias("target"), (F.col("price") / 100000).alias("price"), F.col("n_segments").cast("double").alias("n_segments"), "abnormal_fraction")
    lines = B.line_items(spark, d, "l_orderkey", "l_linenumber", "l_returnflag").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("seg_idx"), (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    named = lines.withColumn("name", F.concat(F.lit("r"), F.col("record_id").cast("string"), F.lit("_p"), F.col("seg_idx").cast("string")))
    runs = C.longest_contiguous(named, memo=(d, "lineitem", "l_orderkey")).select("record_id", F.col("longest_run").cast("double").alias("longest_abnormal_run"))
    return gated_increment(rows.join(runs, "record_id", "left"), ["price", "n_segments"], ["abnormal_fraction", "longest_abnormal_run"], 3)


def gated_increment(rows, base, extra, k):
    """The paired difference with the gate's counts and status; with too few clusters in a class only these."""
    rows = materialize(rows, "increment")
    gate = materialize(O.min_group_gate(rows, [], "target", k), "gate")
    if gate.where(F.col("status") == "ok").isEmpty():
        empty = {"metric": "string", "difference": "double", "lo": "double", "hi": "double", "n_valid": "bigint"}
        return gate.select(*[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()], "*")
    return rounded(T.incremental_value(rows, base, extra, k).crossJoin(gate), "difference", "lo", "hi")


def site_rows(spark, d):
    return B.scored(spark, d).select("record_id", "cluster_id", "site", "target", "m1", "m2")


@query("I08_leave_one_site_out")
def loso_evaluate(spark, d):
    metrics, _, _ = T.loso_evaluate(site_rows(spark, d), ["m1", "m2"])
    return rounded(metrics, *M.EVALUATION_METRICS)


@query("I08_calibration_bins")
def loso_bins(spark, d):
    _, bins, _ = T.loso_evaluate(site_rows(spark, d), ["m1", "m2"])
    return rounded(bins, "mean_prediction", "observed")


MIXED = "({0}_positives > 0 AND {0}_positives < {0}_rows)"


@query("I08_site_plan", f"""WITH pairs AS (SELECT site, cluster_id, count(*) AS n, sum(target) AS pos FROM predictions GROUP BY 1, 2),
clusters AS (SELECT cluster_id, sum(n) AS n, sum(pos) AS pos, CASE WHEN sum(pos) > 0 THEN 1 ELSE 0 END AS stratum, list(site) AS own FROM pairs GROUP BY 1),
away AS (SELECT h.site, c.* FROM clusters c, (SELECT DISTINCT site FROM pairs) h WHERE NOT list_contains(own, h.site)),
folds AS (SELECT site, n, pos, (row_number() OVER (PARTITION BY site, stratum ORDER BY md5('42|' || cluster_id)) - 1) % 5 = 0 AS tunes FROM away),
outside AS (SELECT site, count(*) AS development_clusters, coalesce(sum(n) FILTER (NOT tunes), 0) AS fit_rows, coalesce(sum(pos) FILTER (NOT tunes), 0) AS fit_positives,
 coalesce(sum(n) FILTER (tunes), 0) AS validation_rows, coalesce(sum(pos) FILTER (tunes), 0) AS validation_positives FROM folds GROUP BY 1),
held AS (SELECT site, sum(n) AS held_rows, count(*) AS held_clusters, sum(pos) AS held_positives FROM pairs GROUP BY 1),
counts AS (SELECT site, held_rows, held_clusters, held_positives, coalesce(development_clusters, 0) AS development_clusters, coalesce(fit_rows, 0) AS fit_rows, coalesce(fit_positives, 0) AS fit_positives,
 coalesce(validation_rows, 0) AS validation_rows, coalesce(validation_positives, 0) AS validation_positives FROM held LEFT JOIN outside USING (site))
SELECT site, CAST(held_rows AS BIGINT) AS held_rows, held_clusters, CAST(held_positives AS BIGINT) AS held_positives, development_clusters, CAST(fit_rows AS BIGINT) AS fit_rows,
 CAST(fit_positives AS BIGINT) AS fit_positives, CAST(validation_rows AS BIGINT) AS validation_rows, CAST(validation_positives AS BIGINT) AS validation_positives,
 CASE WHEN NOT ({MIXED.format("held")} AND development_clusters >= 8 AND fit_positives + validation_positives > 0 AND fit_positives + validation_positives < fit_rows + validation_rows) THEN 'insufficient_classes_or_groups'
  WHEN NOT ({MIXED.format("fit")} AND {MIXED.format("validation")}) THEN 'insufficient_validation_classes' ELSE 'ok' END AS status FROM counts""")
def loso_plan_counts(spark, d):
    """Roles and statuses of all sites; nothing is fitted."""
    rows = materialize(site_rows(spark, d).drop("m1", "m2"), "loso")
    sites = [r["site"] for r in rows.select("site").distinct().orderBy("site").collect()]
    return T.loso_roles(rows, sites)[1]
