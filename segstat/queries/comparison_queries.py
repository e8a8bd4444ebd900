"""Bootstrap (G11-G13, G21), selection and cases (H), outcomes (I), disclosure (J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as V
from ..operators import bootstrap as BS, cases as K, disclosure as D, features as X, metrics as M, outcomes as O, selection as L, splits as S
from ..sources import bindings as B
from ..sources.scratch import materialize
from .metric_queries import (AUPRC, AUROC, COHORT, SENS90, SPLIT, curve_sql, evaluation_sql, fixed_threshold, rounded)
from .registry import query
from .signal_queries import LONG, TRAIN, train_clusters
from .source_queries import CONTRACT, window_stats

SEG = ["record_id", "seg_idx"]
SMALL_B = BS.REPLICATES

# --- G: bootstrap ----------------------------------------------------------

WEIGHTS = f"""num AS (SELECT cluster_id, row_number() OVER (ORDER BY md5('42|' || cluster_id)) - 1 AS number FROM (SELECT DISTINCT cluster_id FROM predictions)),
drawn AS (SELECT b, CAST(('0x' || substr(md5('42|' || b || '|' || number), 1, 12)) AS BIGINT) % (SELECT count(*) FROM num) AS number FROM num CROSS JOIN (SELECT CAST(range AS INTEGER) AS b FROM range({SMALL_B}))),
weights AS (SELECT b, cluster_id, count(*) AS weight FROM drawn JOIN num USING (number) GROUP BY ALL)"""


@query("G11_cluster_weights", f"WITH {WEIGHTS} SELECT * FROM weights")
def cluster_weights(spark, d):
    return BS.cluster_weights(B.scored(spark, d), SMALL_B, 42)


REPLICATE_METRICS = ["auroc", "auprc", "brier", "prevalence", "sensitivity_at_spec90", "sensitivity", "specificity", "ppv", "f1", "normal_record_alarm_rate", "false_alarms_per_normal_hour"]


def replicate_sql(source: str, by: str, alarm: str) -> str:
    """CTE 'reps' (b, by, metric, value) for long predictions."""
    on = "b, " + by
    return f"""wa AS (SELECT *, {alarm} AS alarm FROM {source}), wp AS (SELECT p.*, b, weight FROM wa p JOIN weights USING (cluster_id)),
rpoints AS (SELECT {on}, score, sum(weight * target) AS pos, sum(weight * (1 - target)) AS neg FROM wp GROUP BY ALL),
rcurve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {on}) AS p, sum(neg) OVER (PARTITION BY {on}) AS n FROM rpoints WINDOW w AS (PARTITION BY {on} ORDER BY score DESC)),
rk AS (SELECT {on}, {AUROC} AS auroc, {AUPRC} AS auprc, {SENS90} AS sensitivity_at_spec90 FROM rcurve WHERE p > 0 AND n > 0 GROUP BY {on}),
op AS (SELECT {on}, sum(weight * (score - target) * (score - target)) / sum(weight)::DOUBLE AS brier, sum(weight * target) / sum(weight)::DOUBLE AS prevalence,
  sum(weight * target) FILTER (WHERE alarm) / sum(weight * target)::DOUBLE AS sensitivity, 1 - coalesce(sum(weight * (1 - target)) FILTER (WHERE alarm), 0) / sum(weight * (1 - target))::DOUBLE AS specificity,
  sum(weight * target) FILTER (WHERE alarm) / (sum(weight) FILTER (WHERE alarm))::DOUBLE AS ppv, 2 * sum(weight * target) FILTER (WHERE alarm) / (sum(weight * target) + sum(weight) FILTER (WHERE alarm))::DOUBLE AS f1
  FROM wp GROUP BY {on}),
wr AS (SELECT {by}, cluster_id, record_id, count(*) AS segs, count(*) FILTER (WHERE alarm) AS alarms FROM wa GROUP BY ALL HAVING max(target) = 0),
wn AS (SELECT {on}, sum(weight * CASE WHEN alarms > 0 THEN 1 ELSE 0 END) / sum(weight)::DOUBLE AS normal_record_alarm_rate,
  sum(weight * alarms) / (sum(weight * segs) / 12::DOUBLE) AS false_alarms_per_normal_hour FROM wr JOIN weights USING (cluster_id) GROUP BY {on}),
reps AS (UNPIVOT (SELECT * FROM rk JOIN op USING ({on}) LEFT JOIN wn USING ({on})) ON {", ".join(REPLICATE_METRICS)} INTO NAME metric VALUE value)"""


@query("G12_bootstrap_intervals", f"""WITH {WEIGHTS}, {replicate_sql('preds', 'model', 'score >= 0.5')}
SELECT model, metric, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_valid FROM reps GROUP BY ALL""")
def bootstrap_intervals(spark, d):
    return rounded(screened_ends(spark, d), "lo", "hi")


def screened_ends(spark, d):
    """Intervals of all eleven metrics of both models at the fixed threshold, under one table of draws."""
    return BS.bootstrap_ci(fixed_threshold(spark, d), ["model"], SMALL_B, 42, alarm=M.at_or_above(), record="record_id")


PAIRED = f"""{replicate_sql('preds', 'model', 'true')},
deltas AS (SELECT b, metric, max(value) FILTER (WHERE model = 'm1') - max(value) FILTER (WHERE model = 'm2') AS value FROM reps WHERE metric IN ('auroc', 'auprc', 'brier') GROUP BY ALL),
pp AS (SELECT model, score, sum(target) AS pos, sum(1 - target) AS neg FROM preds GROUP BY ALL),
pc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM pp WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
pk AS (SELECT model, {AUROC} AS auroc, {AUPRC} AS auprc FROM pc GROUP BY model),
pb AS (SELECT model, avg((score - target) * (score - target)) AS brier FROM preds GROUP BY model),
pu AS (UNPIVOT (SELECT * FROM pk JOIN pb USING (model)) ON auroc, auprc, brier INTO NAME metric VALUE value),
pt AS (SELECT metric, max(value) FILTER (WHERE model = 'm1') - max(value) FILTER (WHERE model = 'm2') AS difference FROM pu GROUP BY metric),
contrast AS (SELECT metric, round(max(difference), 6) AS difference, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(value) AS n_valid FROM deltas JOIN pt USING (metric) GROUP BY metric)"""


def contrast(spark, d):
    return rounded(BS.paired(B.scored(spark, d), "m1", "m2", SMALL_B), "difference", "lo", "hi")


@query("G13_paired_difference", f"WITH {WEIGHTS}, {PAIRED} SELECT * FROM contrast")
def paired_difference(spark, d):
    return contrast(spark, d)


@query("G21_reverse_contrast", f"WITH {WEIGHTS}, {PAIRED} SELECT metric, -difference AS difference, -hi AS lo, -lo AS hi, n_valid, 'm2' AS left_model, 'm1' AS right_model FROM contrast")
def reverse_contrast(spark, d):
    return M.reverse_contrast(contrast(spark, d).withColumn("left_model", F.lit("m1")).withColumn("right_model", F.lit("m2")))


# --- H: selection ----------------------------------------------------------

SEEDS = [42, 43, 44]
GRID = """grid AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'channel_maxabs' ELSE 'per_segment_z' END AS normalization, CAST(8 * power(2, l_partkey % 5) AS INTEGER) AS width,
 CAST(42 + l_suppkey % 3 AS INTEGER) AS seed, round(avg(l_discount) * 10, 9) AS validation_auprc FROM lineitem GROUP BY ALL)"""


def grid(spark, d):
    """Candidate table of a capacity search, aggregated from the line items."""
    lines = B.table(spark, d, "lineitem").select("l_linestatus", "l_partkey", "l_suppkey", "l_discount")
    return lines.groupBy(
        F.when(F.col("l_linestatus") == "F", "channel_maxabs").otherwise("per_segment_z").alias("normalization"),
        (F.lit(8) * F.pow(F.lit(2), F.col("l_partkey") % 5)).cast("int").alias("width"), (F.lit(42) + F.col("l_suppkey") % 3).cast("int").alias("seed")
    ).agg(F.round(F.avg("l_discount") * 10, 9).alias("validation_auprc"))


@query("H06_best_seed", f"""WITH {GRID} SELECT normalization, width, seed, validation_auprc FROM (SELECT *, row_number() OVER (PARTITION BY normalization, width ORDER BY validation_auprc DESC, list_position([43, 42, 44], seed)) AS k FROM grid) WHERE k = 1""")
def best_seed(spark, d):
    return L.best_seed(grid(spark, d), ["normalization", "width"], [43, 42, 44])


@query("H07_grid_complete", f"""WITH {GRID} SELECT normalization, width, count(*) AS n, list_sort(list(seed)) = [42, 43, 44] AS complete FROM grid WHERE NOT (width = 16 AND seed = 43) GROUP BY ALL""")
def grid_complete(spark, d):
    return L.grid_complete(grid(spark, d).where(~((F.col("width") == 16) & (F.col("seed") == 43))), SEEDS)


CAPACITY = f"""{GRID}, cap AS (SELECT normalization, width, count(*) AS seeds, avg(validation_auprc) AS m, stddev_pop(validation_auprc) AS sd, min(validation_auprc) AS lo, max(validation_auprc) AS hi FROM grid GROUP BY ALL),
arms AS (SELECT *, CASE WHEN width <= 32 THEN 'small' WHEN width >= 64 THEN 'medium' END AS arm FROM cap),
wide AS (SELECT normalization, arm, width, m FROM (SELECT *, row_number() OVER (PARTITION BY normalization, arm ORDER BY m DESC, width) AS k FROM arms) WHERE k = 1),
chosen AS (SELECT * EXCLUDE k FROM (SELECT normalization, arm, width, seed, validation_auprc, m AS width_mean, row_number() OVER (PARTITION BY normalization, arm ORDER BY validation_auprc DESC, seed) AS k FROM grid JOIN wide USING (normalization, width)) WHERE k = 1)"""


@query("H08_capacity_summary", f"WITH {CAPACITY} SELECT normalization, width, seeds, round(m, 6) AS mean_validation_auprc, round(sd, 6) AS std_validation_auprc, round(lo, 6) AS min_validation_auprc, round(hi, 6) AS max_validation_auprc FROM cap")
def capacity_summary(spark, d):
    out = L.capacity_summary(grid(spark, d), SEEDS)
    return rounded(out, *[c for c in out.columns if c.endswith("auprc")])


@query("H08_select_capacity", f"WITH {CAPACITY} SELECT normalization, arm, width, seed, validation_auprc, round(width_mean, 6) AS width_mean FROM chosen")
def select_capacity(spark, d):
    return rounded(L.select_capacity(grid(spark, d), SEEDS), "width_mean")


@query("H09_matched_plan", f"""WITH {CAPACITY}, w AS (SELECT arm, width, width_mean, unnest([42, 43, 44]) AS seed FROM chosen WHERE normalization = 'channel_maxabs')
SELECT w.arm, w.width, round(w.width_mean, 6) AS width_mean, CAST(w.seed AS INTEGER) AS seed, l.validation_auprc AS left_score, r.validation_auprc AS right_score, CASE WHEN l.seed IS NOT NULL AND r.seed IS NOT NULL THEN 'ok' ELSE 'missing_pair' END AS status
FROM w LEFT JOIN grid l ON l.width = w.width AND l.seed = w.seed AND l.normalization = 'channel_maxabs' LEFT JOIN grid r ON r.width = w.width AND r.seed = w.seed AND r.normalization = 'per_segment_z' AND r.seed <> 44""")
def matched_plan(spark, d):
    candidates = grid(spark, d).where(~((F.col("normalization") == "per_segment_z") & (F.col("seed") == 44)))
    whole = grid(spark, d).where(F.col("normalization") == "channel_maxabs")
    return rounded(L.matched_plan(candidates.where(F.col("normalization") == "per_segment_z").unionByName(whole), SEEDS, "channel_maxabs", "per_segment_z"), "width_mean")


SEEDED = """seeded AS (SELECT p.record_id, p.seg_idx, p.cluster_id, p.target, s.seed, 'base' AS model, CASE WHEN (p.record_id + s.seed) % 3 = 0 THEN m2 ELSE m1 END AS score FROM predictions p CROSS JOIN (SELECT unnest([42, 43]) AS seed) s
 UNION ALL SELECT p.record_id, p.seg_idx, p.cluster_id, p.target, s.seed, 'without_events', CASE WHEN (p.record_id + s.seed) % 2 = 0 THEN m2 ELSE m1 END FROM predictions p CROSS JOIN (SELECT unnest([42, 43]) AS seed) s)"""


def seeded(spark, d):
    """Two scored variants under two seeds, mixed from the two models."""
    rows = B.predictions(spark, d).withColumn("seed", F.explode(F.array(F.lit(42), F.lit(43))))
    mix = lambda n: F.when((F.col("record_id") + F.col("seed")) % n == 0, F.col("m2")).otherwise(F.col("m1"))
    both = F.array(F.struct(F.lit("base").alias("model"), mix(3).alias("score")), F.struct(F.lit("without_events").alias("model"), mix(2).alias("score")))
    return rows.select(*SEG, "cluster_id", "target", "seed", F.inline(both))


@query("H10_seed_deltas", f"""WITH {SEEDED}, {curve_sql('seeded', 'seed, model')}, k AS (SELECT seed, model, {AUROC} AS auroc, {AUPRC} AS auprc FROM curve GROUP BY ALL),
b AS (SELECT seed, model, avg((score - target) * (score - target)) AS brier FROM seeded GROUP BY ALL), j AS (SELECT * FROM k JOIN b USING (seed, model))
SELECT x.seed, y.model AS comparator, round(x.auroc - y.auroc, 6) AS auroc_difference, round(x.auprc - y.auprc, 6) AS auprc_difference, round(x.brier - y.brier, 6) AS brier_difference
FROM j x JOIN j y ON x.seed = y.seed AND x.model = 'base' AND y.model = 'without_events'""")
def seed_deltas(spark, d):
    return rounded(L.seed_deltas(seeded(spark, d), "base", ["without_events"]), "auroc_difference", "auprc_difference", "brier_difference")


# Weights that turn segment features into a contribution table.
CONTRIBUTION_WEIGHTS = {"x_mean": 0.02, "x_max": -0.004, "y_mean": 0.03, "n_high": 0.25, "missing_fraction": -1.5}
CONTRIB = LONG.replace("SELECT cluster_id", "SELECT record_id, seg_idx, cluster_id") + """,
contrib AS (SELECT record_id, seg_idx, cluster_id, target, feature, value, round((value - avg(value) OVER (PARTITION BY feature)) * CASE feature """ + " ".join(
    f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in CONTRIBUTION_WEIGHTS.items()) + " END, 9) AS contribution FROM (SELECT * REPLACE (round(value, 9) AS value) FROM long))"


def contributions(spark, d):
    """Long table of linear contributions: weight times the distance from the feature's mean."""
    rows = X.long_features(B.segments(spark, d), B.SEGMENT_FEATURES, [*SEG, "cluster_id", "target"]).withColumn("value", F.round("value", 9))
    means = materialize(rows.groupBy("feature").agg(F.avg("value").alias("_mean")), "means")
    weight = F.create_map(*[e for f, w in CONTRIBUTION_WEIGHTS.items() for e in (F.lit(f), F.lit(w))])[F.col("feature")]
    return rows.join(means, "feature").select(*SEG, "cluster_id", "target", "feature", "value", F.round((F.col("value") - F.col("_mean")) * weight, 9).alias("contribution"))


@query("H12_mean_abs_contribution", f"""WITH {CONTRIB}, m AS (SELECT feature, avg(abs(contribution)) AS v FROM contrib GROUP BY feature)
SELECT feature, round(v, 6) AS mean_abs_contribution, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM m""")
def mean_abs_contribution(spark, d):
    return rounded(K.mean_abs_contribution(contributions(spark, d)), "mean_abs_contribution")


def edges_sql(source: str, bins: int) -> str:
    quantiles = ", ".join(str(k / bins) for k in range(bins + 1))
    return f"""edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{quantiles}]))) AS e FROM {source} GROUP BY feature),
labelled AS (SELECT s.*, e, CAST(len(list_filter(e[2:len(e) - 1], lambda v: v < s.value)) AS INTEGER) AS bin FROM {source} s JOIN edges USING (feature))"""


@query("H14_contribution_direction", f"""WITH {CONTRIB}, {edges_sql('contrib', 4)} SELECT feature, bin, count(*) AS segments, count(DISTINCT cluster_id) AS clusters, round(avg(contribution), 6) AS mean_contribution FROM labelled GROUP BY ALL""")
def contribution_direction(spark, d):
    return rounded(K.contribution_direction(contributions(spark, d)), "mean_contribution")


@query("H15_value_rank", f"""WITH {CONTRIB} SELECT record_id, seg_idx, feature, round((rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY feature), 6) AS percentile_rank FROM contrib""")
def value_rank(spark, d):
    return rounded(K.value_rank(contributions(spark, d), SEG), "percentile_rank")


TRAIN_LONG = TRAIN + ", " + LONG.replace("FROM segments", "FROM segments WHERE cluster_id IN (SELECT cluster_id FROM train)") + ", rl AS (SELECT * REPLACE (round(value, 9) AS value) FROM long)"
RESPONSE = f"""{TRAIN_LONG}, {edges_sql('rl', 8)}, response AS (SELECT feature, bin, e[bin + 1] AS lower, e[least(bin + 2, len(e))] AS upper, count(*) AS n_segments, count(DISTINCT cluster_id) AS clusters, CAST(sum(target) AS BIGINT) AS n_positive,
 count(DISTINCT CASE WHEN target = 1 THEN cluster_id END) AS positive_clusters, count(DISTINCT CASE WHEN target = 0 THEN cluster_id END) AS negative_clusters, avg(target) AS positive_fraction FROM labelled GROUP BY ALL)"""


def response(spark, d):
    train = B.segments(spark, d).join(train_clusters(spark, d), "cluster_id", "left_semi")
    return K.feature_response(X.long_features(train, B.SEGMENT_FEATURES, ["cluster_id", "target"]).withColumn("value", F.round("value", 9)))


@query("H16_feature_response", f"WITH {RESPONSE} SELECT * REPLACE (round(lower, 6) AS lower, round(upper, 6) AS upper, round(positive_fraction, 6) AS positive_fraction) FROM response")
def feature_response(spark, d):
    return rounded(response(spark, d), "lower", "upper", "positive_fraction")


@query("H17_top_contributors", f"""WITH {CONTRIB} SELECT * FROM (SELECT record_id, seg_idx, feature, round(contribution, 6) AS contribution, CAST(row_number() OVER (PARTITION BY record_id, seg_idx ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM contrib) WHERE rank <= 3""")
def top_contributors(spark, d):
    return rounded(K.top_contributors(contributions(spark, d), SEG, 3).select(*SEG, "feature", "contribution", "rank"), "contribution")


CATEGORY = "CASE WHEN target = 1 THEN CASE WHEN m1 >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN m1 >= 0.5 THEN 'FP' ELSE 'TN' END END"


def unit_scores(spark, d):
    return B.predictions(spark, d).select(*SEG, "cluster_id", "target", F.col("m1").alias("score"), F.lit(0.5).alias("threshold"))


@query("H18_case_category", f"SELECT record_id, seg_idx, {CATEGORY} AS category FROM predictions")
def case_category(spark, d):
    return K.case_category(unit_scores(spark, d)).select(*SEG, "category")


EXTREME = f"""cat AS (SELECT record_id, seg_idx, cluster_id, target, m1 AS score, 0.5::DOUBLE AS threshold, {CATEGORY} AS category FROM predictions),
extreme AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category IN ('FN', 'TN') THEN score ELSE -score END, record_id, seg_idx) AS INTEGER) AS case_number FROM cat) WHERE case_number <= 2)"""


@query("H19_extreme_cases", f"WITH {EXTREME} SELECT * FROM extreme")
def extreme_cases(spark, d):
    return K.extreme_cases(unit_scores(spark, d))


@query("H20_case_signals", """WITH c AS (SELECT record_id, seg_idx, target, score, 0.5::DOUBLE AS threshold, CASE WHEN target = 1 THEN CASE WHEN score >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END END AS category
 FROM (SELECT * REPLACE (round(score, 9) AS score) FROM segments)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category IN ('FN', 'TN') THEN score ELSE -score END, record_id, seg_idx) AS k FROM c) WHERE k <= 2)
SELECT record_id, seg_idx, category, sample_idx, x, y, 'ok' AS alignment FROM e JOIN samples USING (record_id, seg_idx)""")
def case_signals(spark, d):
    units = B.segments(spark, d).select(*SEG, "target", F.round("score", 9).alias("score"), F.lit(0.5).alias("threshold"))
    aligned = K.case_signals(K.extreme_cases(units), units.select(*SEG, "target"))
    return aligned.join(B.samples(spark, d).select(*SEG, "sample_idx", "x", "y"), SEG).select(*SEG, "category", "sample_idx", "x", "y", "alignment")


JOBS = """history AS (SELECT record_id AS job, seg_idx * 10 + sample_idx + 1 AS iteration, y / 100 AS score, x / 100 AS loss FROM samples),
best AS (SELECT job, count(*) AS iterations_run, max(score) AS best_score FROM history GROUP BY job),
roll AS (SELECT b.job, iterations_run, best_score, min(iteration) AS best_iteration FROM best b JOIN history h ON b.job = h.job AND h.score > b.best_score - 1e-8 GROUP BY ALL)"""


def history(spark, d):
    return B.samples(spark, d).select(F.col("record_id").alias("job"), (F.col("seg_idx") * 10 + F.col("sample_idx") + 1).alias("iteration"), (F.col("y") / 100).alias("score"), (F.col("x") / 100).alias("loss"))


@query("H21_stop_diagnosis", f"""WITH {JOBS}, j AS (SELECT job, CASE WHEN job % 13 = 0 THEN NULL ELSE iterations_run END AS iterations_run, best_iteration, CAST(70 AS BIGINT) AS cap, CAST(30 AS BIGINT) AS patience, job % 11 <> 0 AS complete FROM roll),
s AS (SELECT *, CAST(iterations_run - best_iteration AS DOUBLE) AS stale_iterations, iterations_run >= cap AS hit_cap, iterations_run - best_iteration >= patience AS patience_met FROM j)
SELECT *, CASE WHEN NOT complete THEN 'incomplete_or_running' WHEN iterations_run IS NULL THEN 'uncollected' WHEN hit_cap THEN 'budget_cap' WHEN patience_met THEN 'early_stopping' ELSE 'unknown_stop' END AS stop_reason FROM s""")
def stop_diagnosis(spark, d):
    rolled = L.history_rollup(history(spark, d)).select("job", F.when(F.col("job") % 13 != 0, F.col("iterations_run")).alias("iterations_run"), "best_iteration",
                                                        F.lit(70).cast("bigint").alias("cap"), F.lit(30).cast("bigint").alias("patience"), (F.col("job") % 11 != 0).alias("complete"))
    return L.stop_diagnosis(rolled)


@query("H22_recent_gain", f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY iteration DESC) AS k FROM history)
SELECT job, count(*) FILTER (WHERE k <= 20) AS recent_window, round(max(score) FILTER (WHERE k <= 20) - max(score) FILTER (WHERE k > 20), 6) AS recent_best_gain, round(max(score) FILTER (WHERE k = 1), 6) AS last_score FROM r GROUP BY job""")
def recent_gain(spark, d):
    return rounded(L.recent_gain(history(spark, d)), "recent_best_gain", "last_score")


@query("H23_history_rollup", f"""WITH {JOBS} SELECT job, iterations_run, round(best_score, 6) AS best_score, best_iteration, round((SELECT arg_max(score, iteration) FROM history h WHERE h.job = roll.job), 6) AS last_score FROM roll""")
def history_rollup(spark, d):
    return rounded(L.history_rollup(history(spark, d)), "best_score", "last_score")


SITE_CONTRASTS = """contrasts AS (SELECT site, round(avg(m1 - m2), 6) AS difference, CASE WHEN site % 6 <> 0 THEN round(avg(m1 - m2) - 1.96::DOUBLE * stddev_samp(m1 - m2) / sqrt(count(*)), 6) END AS lo,
 CASE WHEN site % 6 <> 0 THEN round(avg(m1 - m2) + 1.96::DOUBLE * stddev_samp(m1 - m2) / sqrt(count(*)), 6) END AS hi FROM predictions GROUP BY site)"""


@query("H24_evidence_label", f"""WITH {SITE_CONTRASTS} SELECT *, CASE WHEN lo IS NULL OR hi IS NULL THEN 'not_available_or_suppressed' WHEN lo > 0 THEN 'positive_interval' WHEN hi < 0 THEN 'negative_interval' ELSE 'inconclusive_not_equivalent' END AS evidence FROM contrasts""")
def evidence_label(spark, d):
    gap = F.col("m1") - F.col("m2")
    half = F.lit(1.96) * F.stddev_samp(gap) / F.sqrt(F.count(F.lit(1)))
    shown = F.col("site") % 6 != 0
    rows = B.scored(spark, d).groupBy("site").agg(F.avg(gap).alias("difference"), (F.avg(gap) - half).alias("lo"), (F.avg(gap) + half).alias("hi"))
    return L.evidence_label(rounded(rows.select("site", "difference", F.when(shown, F.col("lo")).alias("lo"), F.when(shown, F.col("hi")).alias("hi")), "difference", "lo", "hi"))


BOXES = """boxes AS (SELECT record_id, seg_idx, 5.0::DOUBLE * ((record_id * 7 + seg_idx * 31) % 140) AS cx, 40.0 + 10 * (seg_idx % 9) AS cy, 30.0 + 50 * m1 AS w, 80.0 AS h, m1 AS obj, 1 - m2 / 2 AS cls FROM predictions)"""


def detector_boxes(spark, d):
    """Detector-like boxes, one per scored unit, on a 640-wide image per record."""
    return B.predictions(spark, d).select(
        "record_id", F.col("seg_idx").alias("box_no"), (F.lit(5.0) * ((F.col("record_id") * 7 + F.col("seg_idx") * 31) % 140)).alias("cx"), (F.lit(40.0) + 10 * (F.col("seg_idx") % 9)).alias("cy"),
        (F.lit(30.0) + 50 * F.col("m1")).alias("w"), F.lit(80.0).alias("h"), F.col("m1").alias("obj"), (1 - F.col("m2") / 2).alias("cls"))


@query("H25_box_segment_score", f"""WITH {BOXES}, n AS (SELECT record_id, count(*) AS n FROM predictions GROUP BY 1), g AS (SELECT record_id, unnest(range(n)) AS seg_idx FROM n),
s AS (SELECT record_id, least(CAST(floor(least(greatest(((cx - w / 2) + (cx + w / 2)) / 2, 0), 640) / 640 * n) AS BIGINT), n - 1) AS seg_idx, max(obj * cls) AS score FROM boxes JOIN n USING (record_id) GROUP BY ALL)
SELECT record_id, seg_idx, round(coalesce(score, 0), 6) AS score FROM g LEFT JOIN s USING (record_id, seg_idx)""")
def box_segment_score(spark, d):
    raw = detector_boxes(spark, d)
    boxes = raw.select("record_id", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("obj") * F.col("cls")).alias("confidence"))
    dims = raw.groupBy("record_id").agg(F.lit(640).alias("width"), F.count(F.lit(1)).alias("n_segments"))
    return rounded(K.box_segment_score(boxes, dims), "score")


IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) / greatest(
 greatest(a.x2 - a.x1, 0) * greatest(a.y2 - a.y1, 0) + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0), 1e-12)"""


@query("H26_box_suppression", f"""WITH RECURSIVE {BOXES}, sc AS (SELECT record_id, struct_pack(s := obj * cls, box_no := seg_idx, x1 := cx - w / 2, y1 := cy - h / 2, x2 := cx + w / 2, y2 := cy + h / 2) AS b FROM boxes WHERE obj * cls > 0.001),
start AS (SELECT record_id, list(b ORDER BY b.s DESC, b.box_no) AS rest FROM sc GROUP BY 1),
walk AS (SELECT record_id, rest[1] AS a, rest[2:] AS rest FROM start
  UNION ALL SELECT record_id, r[1], r[2:] FROM (SELECT record_id, list_filter(rest, lambda b: {IOU} <= 0.6) AS r FROM walk) WHERE len(r) > 0)
SELECT record_id, a.box_no AS box_no, round(a.x1, 6) AS x1, round(a.y1, 6) AS y1, round(a.x2, 6) AS x2, round(a.y2, 6) AS y2, round(a.s, 6) AS score FROM walk""")
def nms(spark, d):
    return rounded(K.nms(detector_boxes(spark, d)), "x1", "y1", "x2", "y2", "score")


# --- I: outcomes -----------------------------------------------------------

OBSERVED = "o AS (SELECT *, quality IS NOT NULL AS observed, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS reading, 1 - quality AS low FROM doc_outcomes)"


def observed_docs(spark, d):
    return B.doc_outcomes(spark, d).withColumn("observed", F.col("quality").isNotNull()).withColumn("reading", (F.col("n_chars") > 2000).cast("int")).withColumn("low", 1 - F.col("quality"))


@query("I01_cohort_descriptors", f"""WITH {OBSERVED} SELECT observed, count(*) AS records, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (WHERE reading = 1) AS reading_positive_records, count(*) FILTER (WHERE reading = 0) AS reading_negative_records,
count(DISTINCT CASE WHEN reading = 1 THEN cluster_id END) AS reading_positive_clusters, count(DISTINCT CASE WHEN reading = 0 THEN cluster_id END) AS reading_negative_clusters FROM o GROUP BY observed""")
def cohort_descriptors(spark, d):
    return O.cohort_descriptors(observed_docs(spark, d), ["observed"], "reading")


@query("I01_variable_descriptors", f"""WITH {OBSERVED}, v AS (SELECT observed, cluster_id, 'n_chars' AS variable, CAST(n_chars AS DOUBLE) AS value FROM o UNION ALL SELECT observed, cluster_id, 'toxic', toxic FROM o)
SELECT observed, variable, count(value) AS observed_records, count(DISTINCT CASE WHEN value IS NOT NULL THEN cluster_id END) AS observed_clusters, count(*) - count(value) AS missing_records,
count(DISTINCT CASE WHEN value IS NULL THEN cluster_id END) AS missing_clusters, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM v GROUP BY ALL""")
def variable_descriptors(spark, d):
    return rounded(O.variable_descriptors(observed_docs(spark, d), ["observed"], ["n_chars", "toxic"]), "mean", "median")


CELLS = f"""{OBSERVED}, c AS (SELECT site, reading AS reading_positive, low AS outcome_positive, count(*) AS records, count(DISTINCT cluster_id) AS clusters FROM o WHERE observed GROUP BY ALL),
cells AS (SELECT site, CAST(reading_positive AS INTEGER) AS reading_positive, CAST(outcome_positive AS INTEGER) AS outcome_positive, coalesce(records, 0) AS records, coalesce(clusters, 0) AS clusters
 FROM (SELECT DISTINCT site, unnest([0, 0, 1, 1]) AS reading_positive, unnest([0, 1, 0, 1]) AS outcome_positive FROM c) LEFT JOIN c USING (site, reading_positive, outcome_positive))"""


def cells(spark, d):
    return O.reading_outcome_cells(observed_docs(spark, d).where("observed"), ["site"], "reading", "low")


@query("I02_reading_outcome_cells", f"WITH {CELLS} SELECT * FROM cells")
def reading_outcome_cells(spark, d):
    return cells(spark, d)


@query("I02_cross_table", f"WITH {CELLS} SELECT site, reading_positive, CAST(sum(records) FILTER (WHERE outcome_positive = 0) AS BIGINT) AS outcome_0, CAST(sum(records) FILTER (WHERE outcome_positive = 1) AS BIGINT) AS outcome_1 FROM cells GROUP BY ALL")
def cross_table(spark, d):
    return O.cross_table(cells(spark, d), ["site"])


@query("I03_reading_rates", f"WITH {CELLS} SELECT site, reading_positive, CAST(sum(records) AS BIGINT) AS total, CAST(sum(records) FILTER (WHERE outcome_positive = 1) AS BIGINT) AS positive, round(sum(records) FILTER (WHERE outcome_positive = 1) / nullif(sum(records), 0)::DOUBLE, 6) AS rate FROM cells GROUP BY ALL")
def reading_rates(spark, d):
    return rounded(O.reading_rates(cells(spark, d), ["site"]), "rate")


@query("I04_min_group_gate", f"""WITH {OBSERVED} SELECT site, count(DISTINCT CASE WHEN low = 1 THEN cluster_id END) AS positive_clusters, count(DISTINCT CASE WHEN low = 0 THEN cluster_id END) AS negative_clusters, CAST(10 AS BIGINT) AS min_groups,
CASE WHEN least(count(DISTINCT CASE WHEN low = 1 THEN cluster_id END), count(DISTINCT CASE WHEN low = 0 THEN cluster_id END)) >= 10 THEN 'ok' ELSE 'insufficient_outcome_groups' END AS status FROM o WHERE observed GROUP BY site""")
def min_group_gate(spark, d):
    return O.min_group_gate(observed_docs(spark, d).where("observed"), ["site"], "low", 5)


@query("I05_fraction_auroc", f"""WITH f AS (SELECT site, abnormal_fraction AS score, CASE WHEN balance < 2000 THEN 1 ELSE 0 END AS target FROM records WHERE balance >= 0 AND abnormal_fraction IS NOT NULL), {curve_sql('f', 'site')}
SELECT site, round({AUROC}, 6) AS auroc FROM curve GROUP BY site""")
def fraction_auroc(spark, d):
    rows = B.records(spark, d).where(F.col("balance") >= 0).withColumn("target", (F.col("balance") < 2000).cast("int"))
    return rounded(O.fraction_auroc(rows, ["site"], "abnormal_fraction", "target"), "auroc")


MAPPING = [("price", "score_mean", "continuous"), ("has_many", "n_late", "binary"), ("urgent", "n_positive", "acceleration"), ("constant", "n_positive", "binary")]


@query("I06_annotation_agreement", f"""WITH r AS (SELECT record_id, price, CASE WHEN n_segments > 3 THEN 2 ELSE 0 END AS has_many, CASE WHEN priority = '1-URGENT' THEN 1 ELSE 2 END AS urgent, 1 AS constant FROM records),
s AS (SELECT record_id, avg(round(m1, 9)) AS score_mean, CAST(sum(CASE WHEN m2 > 0.75 THEN 1 ELSE 0 END) AS DOUBLE) AS n_late, CAST(sum(target) AS DOUBLE) AS n_positive FROM predictions GROUP BY 1),
l AS (SELECT 'price' AS label, 'score_mean' AS feature, 'continuous' AS kind, price AS y, round(score_mean, 9) AS x FROM r JOIN s USING (record_id) UNION ALL SELECT 'has_many', 'n_late', 'binary', has_many, n_late FROM r JOIN s USING (record_id)
 UNION ALL SELECT 'urgent', 'n_positive', 'acceleration', urgent, n_positive FROM r JOIN s USING (record_id) UNION ALL SELECT 'constant', 'n_positive', 'binary', constant, n_positive FROM r JOIN s USING (record_id)),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0::DOUBLE AS ry,
  CASE WHEN kind = 'acceleration' THEN CASE WHEN y = 1 THEN 1 ELSE 0 END ELSE CASE WHEN y > 0 THEN 1 ELSE 0 END END AS pos FROM l),
m AS (SELECT label, feature, kind, count(*) AS n, min(x) < max(x) AND min(y) < max(y) AND count(*) >= 5 AS good, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho, avg(abs(x - y)) AS mae,
  (sum(rx * pos) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / nullif(sum(pos)::DOUBLE * sum(1 - pos), 0) AS auc FROM k GROUP BY ALL)
SELECT label, feature, kind, n, CASE WHEN good THEN 'ok' ELSE 'constant_or_insufficient' END AS status, CASE WHEN good THEN round(rho, 6) END AS spearman, CASE WHEN good AND kind = 'continuous' THEN round(mae, 6) END AS mae,
CASE WHEN good AND kind <> 'continuous' THEN round(auc, 6) END AS auroc FROM m""")
def annotation_agreement(spark, d):
    records = B.records(spark, d).select("record_id", "price", F.when(F.col("n_segments") > 3, 2).otherwise(0).alias("has_many"),
                                         F.when(F.col("priority") == "1-URGENT", 1).otherwise(2).alias("urgent"), F.lit(1).alias("constant"))
    units = B.scored(spark, d).select("record_id", F.round("m1", 9).alias("score_mean"), (F.col("m2") > 0.75).cast("int").alias("n_late"), F.col("target").alias("n_positive"))
    return rounded(O.annotation_agreement(records, units, MAPPING), "spearman", "mae", "auroc")


ARMS = """arms AS (SELECT record_id, seg_idx, cluster_id, target, s.seed, a.arm, CASE WHEN (record_id + s.seed) % a.mix = 0 THEN m2 ELSE m1 END AS score FROM predictions CROSS JOIN (SELECT unnest([42, 43, 44]) AS seed) s
 CROSS JOIN (SELECT 'base' AS arm, 3 AS mix UNION ALL SELECT 'with_extra', 2) a)"""


def arm_scores(rows):
    seeds = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    mix = lambda n: F.when((F.col("record_id") + F.col("seed")) % n == 0, F.col("m2")).otherwise(F.col("m1"))
    return seeds.select(*[c for c in rows.columns if c not in ("m1", "m2")], "seed",
                        F.inline(F.array(F.struct(F.lit("base").alias("arm"), mix(3).alias("score")), F.struct(F.lit("with_extra").alias("arm"), mix(2).alias("score")))))


@query("I09_added_arm", f"""WITH {SPLIT}, {ARMS}, val AS (SELECT a.* FROM arms a JOIN split USING (cluster_id) WHERE split = 'val'), tst AS (SELECT a.* FROM arms a JOIN split USING (cluster_id) WHERE split = 'test'),
{curve_sql('val', 'arm, seed')}, v AS (SELECT arm, seed, round({AUPRC}, 6) AS validation_auprc FROM curve GROUP BY ALL),
pts AS (SELECT arm, seed, score, sum(target) AS pos, sum(1 - target) AS neg FROM tst GROUP BY ALL),
crv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm, seed) AS p, sum(neg) OVER (PARTITION BY arm, seed) AS n FROM pts WINDOW w AS (PARTITION BY arm, seed ORDER BY score DESC)),
t AS (SELECT arm, seed, {AUPRC} AS auprc FROM crv GROUP BY ALL),
sel AS (SELECT arm, seed AS selected_seed FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY validation_auprc DESC, seed) AS k FROM v) WHERE k = 1)
SELECT CAST(b.seed AS INTEGER) AS seed, b.validation_auprc AS base_validation_auprc, e.validation_auprc AS added_validation_auprc, round(te.auprc - tb.auprc, 6) AS auprc_difference,
b.seed = sb.selected_seed AS base_selected, b.seed = se.selected_seed AS added_selected
FROM v b JOIN v e ON b.seed = e.seed AND b.arm = 'base' AND e.arm = 'with_extra' JOIN t tb ON tb.seed = b.seed AND tb.arm = 'base' JOIN t te ON te.seed = b.seed AND te.arm = 'with_extra'
JOIN sel sb ON sb.arm = 'base' JOIN sel se ON se.arm = 'with_extra'""")
def added_arm(spark, d):
    """Same split, seeds and selection rule for both arms; seed-matched differences on test rows."""
    rows = B.scored(spark, d)
    split = materialize(S.holdout_split(rows), "split")
    scored = arm_scores(S.assign(rows, split.where(F.col("split") != "train")).select("record_id", "cluster_id", "split", "target", "m1", "m2"))
    auprc = materialize(M.average_precision(scored, ["split", "arm", "seed"]), "arms")
    validation = auprc.where(F.col("split") == "val").select("arm", "seed", F.round("auprc", 6).alias("validation_auprc"))
    chosen = L.best_seed(validation, ["arm"], SEEDS).select("arm", F.col("seed").alias("selected_seed"))
    test = auprc.where(F.col("split") == "test").select("arm", "seed", "auprc")
    table = validation.join(test, ["arm", "seed"]).join(chosen, "arm")
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    picked = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("seed") == F.col("selected_seed")))
    out = table.groupBy("seed").agg(pick("base", "validation_auprc").alias("base_validation_auprc"), pick("with_extra", "validation_auprc").alias("added_validation_auprc"),
                                    (pick("with_extra", "auprc") - pick("base", "auprc")).alias("auprc_difference"), picked("base").alias("base_selected"), picked("with_extra").alias("added_selected"))
    return rounded(out, "auprc_difference")


# --- J: disclosure ---------------------------------------------------------

RARE = """rare AS (SELECT record_id, o_custkey AS cluster_id, c_nationkey AS site, CASE WHEN l_returnflag = 'R' AND l_discount = 0.10 AND l_quantity > 45 THEN 1 ELSE 0 END AS target, l_quantity / 50 AS score
 FROM (SELECT *, l_orderkey AS record_id FROM lineitem) JOIN orders ON record_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def rare(spark, d):
    """Predictions with a rare positive class, so that small cells occur."""
    lines = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_returnflag", "l_discount", "l_quantity")
    owners = B.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(B.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    hit = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.10) & (F.col("l_quantity") > 45)
    return lines.join(owners, F.col("record_id") == F.col("o_orderkey")).select("record_id", F.col("o_custkey").alias("cluster_id"), F.col("c_nationkey").alias("site"), hit.cast("int").alias("target"), (F.col("l_quantity") / 50).alias("score"))


STATUS = "CASE WHEN {ok} THEN 'screened_aggregate_pending_review' ELSE 'suppressed_requires_review' END AS review_status"


def shown(columns, ok="ok"):
    return ", ".join(f"CASE WHEN {ok} THEN {c} END AS {c}" for c in columns)


COUNTS = ["n", "clusters", "positives", "positive_clusters", "negative_clusters"]
CLASS_OK = "least(clusters, positive_clusters, negative_clusters) >= 10"


@query("J01_primary_suppression", f"WITH {RARE}, c AS (SELECT site, {COHORT} FROM rare GROUP BY site), k AS (SELECT *, {CLASS_OK} AS ok FROM c) SELECT site, {shown(COUNTS)}, {STATUS.format(ok='ok')} FROM k")
def primary_suppression(spark, d):
    return D.screen(M.cohort_counts(rare(spark, d), ["site"]), COUNTS)


HIST_CELLS = """h AS (SELECT site, target AS actual, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, count(*) AS segments, count(DISTINCT cluster_id) AS clusters FROM rare GROUP BY ALL)"""


def hist_cells(spark, d):
    rows = rare(spark, d).withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int")).withColumnRenamed("target", "actual")
    return rows.groupBy("site", "actual", "bin", "cluster_id").agg(F.count(F.lit(1)).alias("s")).groupBy("site", "actual", "bin").agg(F.sum("s").alias("segments"), F.count("cluster_id").alias("clusters"))


@query("J02_partition_suppression", f"WITH {RARE}, {HIST_CELLS}, k AS (SELECT *, bool_and(clusters = 0 OR clusters >= 3) OVER (PARTITION BY site) AS ok FROM h) SELECT site, actual, bin, {shown(['segments', 'clusters'])}, {STATUS.format(ok='ok')} FROM k")
def partition_suppression(spark, d):
    return D.screen_partition(hist_cells(spark, d), ["site"], ["segments", "clusters"], "clusters", 3)


RESPONSE_NUMBERS = ["n_segments", "clusters", "n_positive", "positive_clusters", "negative_clusters", "positive_fraction"]


@query("J03_complementary_suppression", f"""WITH {RESPONSE}, k AS (SELECT * REPLACE (round(positive_fraction, 6) AS positive_fraction), bool_and(least(clusters, positive_clusters, negative_clusters) >= 20) OVER (PARTITION BY feature) AS ok FROM response)
SELECT feature, bin, {shown(RESPONSE_NUMBERS)}, {STATUS.format(ok='ok')} FROM k""")
def complementary_suppression(spark, d):
    rows = rounded(response(spark, d).select("feature", "bin", *RESPONSE_NUMBERS), "positive_fraction")
    return D.screen_complementary(rows, ["feature"], RESPONSE_NUMBERS, minimum=20)


ALARM_NUMBERS = ["n", "clusters", "auroc", "normal_record_alarm_rate", "false_alarms_per_normal_hour"]
ALARM_OK = "least(normal_clusters, normal_alarm_clusters, normal_quiet_clusters) >= 10"


@query("J04_alarm_suppression", f"""WITH {evaluation_sql('preds', 'model, site', 'score >= 0.5')}, k AS (SELECT *, {CLASS_OK} AS ok, {ALARM_OK} AS own FROM evaluated)
SELECT model, site, {shown(ALARM_NUMBERS[:3])}, {shown(ALARM_NUMBERS[3:], 'ok AND own')}, {STATUS.format(ok='ok')} FROM k""")
def alarm_suppression(spark, d):
    rows = rounded(M.evaluate(fixed_threshold(spark, d), ["model", "site"], M.at_or_above()), *M.EVALUATION_METRICS)
    return D.screen_alarm_metrics(rows, ALARM_NUMBERS).select("model", "site", *ALARM_NUMBERS, "review_status")


MOMENTS = ["n", "clusters", "zero_fraction", "mean", "std"]


@query("J05_moment_suppression", f"""WITH {LONG}, q AS (SELECT feature, {COHORT}, count(DISTINCT CASE WHEN value = 0 THEN cluster_id END) AS zc, count(DISTINCT CASE WHEN value <> 0 THEN cluster_id END) AS nc,
round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY feature),
k AS (SELECT *, {CLASS_OK} AND (zc = 0 OR zc >= 10) AND (nc = 0 OR nc >= 10) AS ok FROM q) SELECT feature, {shown(MOMENTS)}, {STATUS.format(ok='ok')} FROM k""")
def moment_suppression(spark, d):
    quality = X.feature_quality(B.segments(spark, d), B.SEGMENT_FEATURES, ())
    return rounded(D.screen_moments(quality, MOMENTS).select("feature", *MOMENTS, "review_status"), "zero_fraction", "mean", "std")


@query("J06_contributor_suppression", f"""WITH {CONTRIB}, c AS (SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution, {COHORT} FROM contrib WHERE abs(contribution) > CASE feature WHEN 'x_max' THEN 1.2 WHEN 'n_high' THEN 0.6 ELSE 0.1 END GROUP BY feature),
k AS (SELECT *, {CLASS_OK} AS ok FROM c) SELECT feature, {shown(['mean_abs_contribution', 'clusters'])}, {STATUS.format(ok='ok')} FROM k""")
def contributor_suppression(spark, d):
    """Denominators come from the rows that contributed to the aggregate, not from the cohort."""
    floor = F.when(F.col("feature") == "x_max", 1.2).when(F.col("feature") == "n_high", 0.6).otherwise(0.1)
    used = contributions(spark, d).where(F.abs("contribution") > floor)
    means = used.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    joined = means.join(M.cohort_counts(used, ["feature"]), "feature")
    return rounded(D.screen(joined, ["mean_abs_contribution", "clusters"]).select("feature", "mean_abs_contribution", "clusters", "review_status"), "mean_abs_contribution")


@query("J07_pseudonyms", f"WITH c AS (SELECT site, {COHORT} FROM predictions GROUP BY site) SELECT 'S' || lpad(CAST(row_number() OVER (ORDER BY site) AS VARCHAR), 2, '0') AS alias, * EXCLUDE site FROM c")
def pseudonyms(spark, d):
    return D.pseudonymise(M.cohort_counts(B.scored(spark, d), ["site"]), "site")


@query("J08_release_counts", f"WITH {RARE}, {HIST_CELLS} SELECT site, actual, bin, CASE WHEN segments = 0 OR segments >= 10 THEN segments END AS segments FROM h")
def release_counts(spark, d):
    return hist_cells(spark, d).select("site", "actual", "bin", D.release_count(F.col("segments")).alias("segments"))


@query("J09_banned_columns", """SELECT unnest(['cohort_counts', 'predictions', 'predictions', 'predictions', 'predictions', 'predictions']) AS section, unnest([NULL, 'cluster_id', 'record_id', 'score', 'seg_idx', 'target']) AS banned, unnest([(SELECT count(*) FROM (SELECT DISTINCT site FROM predictions)), n, n, n, n, n]) AS rows FROM (SELECT count(*) AS n FROM predictions)""")
def banned(spark, d):
    """Scans the schemas of a releasable and a non-releasable table."""
    tables = {"cohort_counts": M.cohort_counts(B.scored(spark, d), ["site"]), "predictions": B.predictions(spark, d).withColumnRenamed("m1", "score")}
    out = None
    for section, df in tables.items():
        names = D.banned_columns(df) or [None]
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(section).alias("section"), F.explode(F.array(*[F.lit(n).cast("string") for n in names])).alias("banned"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("J10_coverage", f"""WITH {RARE}, c AS (SELECT site, {COHORT} FROM rare GROUP BY site), {HIST_CELLS}, k AS (SELECT bool_and(clusters = 0 OR clusters >= 3) OVER (PARTITION BY site) AS ok FROM h)
SELECT 'site_counts' AS section, count(*) AS rows, count(*) FILTER (WHERE NOT ({CLASS_OK})) AS suppressed_rows, 'available' AS status FROM c
UNION ALL SELECT 'score_cells', count(*), count(*) FILTER (WHERE NOT ok), 'available' FROM k UNION ALL SELECT 'nothing', 0, 0, 'uncollected'""")
def coverage(spark, d):
    sites = D.screen(M.cohort_counts(rare(spark, d), ["site"]), COUNTS)
    cell = D.screen_partition(hist_cells(spark, d), ["site"], ["segments", "clusters"], "clusters", 3)
    return D.coverage({"site_counts": sites, "score_cells": cell, "nothing": sites.where("site < 0")})


@query("J11_screened_composition", """WITH c AS (SELECT site, count(*) AS records, count(DISTINCT cluster_id) AS clusters, CAST(sum(n_segments) AS BIGINT) AS segments, CAST(coalesce(sum(any_abnormal), 0) AS BIGINT) AS positive_records,
 count(DISTINCT CASE WHEN any_abnormal = 1 THEN cluster_id END) AS pc, count(DISTINCT CASE WHEN any_abnormal = 0 THEN cluster_id END) AS qc FROM records GROUP BY site),
k AS (SELECT *, clusters >= 6 AND (pc = 0 OR pc >= 6) AND (qc = 0 OR qc >= 6) AS ok FROM c)
SELECT 'S' || lpad(CAST(row_number() OVER (ORDER BY site) AS VARCHAR), 2, '0') AS alias, """ + shown(["records", "clusters", "segments", "positive_records"]) + ", " + STATUS.format(ok="ok") + " FROM k")
def screened_composition(spark, d):
    rows = B.records(spark, d)
    per_cluster = rows.groupBy("site", "cluster_id").agg(F.count(F.lit(1)).alias("r"), F.sum("n_segments").alias("s"), F.sum("any_abnormal").alias("p"), F.count_if(F.col("any_abnormal") == 0).alias("q"))
    table = per_cluster.groupBy("site").agg(F.sum("r").alias("records"), F.count(F.lit(1)).alias("clusters"), F.sum("s").alias("segments"), F.coalesce(F.sum("p"), F.lit(0)).alias("positive_records"),
                                            F.count_if(F.col("p") > 0).alias("_pc"), F.count_if(F.col("q") > 0).alias("_qc"))
    ok = D.enough(["clusters"], 6) & D.empty_or_enough("_pc", 6) & D.empty_or_enough("_qc", 6)
    return D.pseudonymise(D.apply_screen(table, ["records", "clusters", "segments", "positive_records"], ok).drop("_pc", "_qc"), "site")


# Break-downs of one cohort by site and by the reason a record is left out.
LINKED_MINIMUM = 50
LINKED = ["records", "clusters", "segments", "positive_records"]
REASON_SQL = "CASE WHEN n_segments IS NULL THEN 'no_segments' WHEN n_segments < 2 THEN 'single_segment' WHEN balance < 0 THEN 'negative_balance' ELSE 'kept' END"


def linked_sql(name: str, key: str) -> str:
    enough_sql = " AND ".join(["clusters >= {m}", "(pc = 0 OR pc >= {m})", "(qc = 0 OR qc >= {m})"]).format(m=LINKED_MINIMUM)
    return f"""{name}_c AS (SELECT {key} AS cell, count(*) AS records, count(DISTINCT cluster_id) AS clusters, CAST(coalesce(sum(n_segments), 0) AS BIGINT) AS segments, CAST(coalesce(sum(any_abnormal), 0) AS BIGINT) AS positive_records,
 count(DISTINCT CASE WHEN any_abnormal = 1 THEN cluster_id END) AS pc, count(DISTINCT CASE WHEN any_abnormal = 0 THEN cluster_id END) AS qc FROM lr GROUP BY 1),
{name}_k AS (SELECT *, {enough_sql} AS ok, ({enough_sql}) AND clusters >= {LINKED_MINIMUM} AS free FROM {name}_c),
{name}_w AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER () AS hidden, max(CASE WHEN NOT ok THEN clusters END) OVER () AS widest, count(*) FILTER (WHERE free) OVER () AS choices, row_number() OVER (ORDER BY free DESC, clusters, cell) AS turn FROM {name}_k),
{name}_o AS (SELECT *, hidden > 0 AND (hidden = 1 OR coalesce(widest < {LINKED_MINIMUM}, true)) AS opened FROM {name}_w)"""


LINKED_SQL = f"""lr AS (SELECT *, {REASON_SQL} AS reason FROM records), {linked_sql('s', 'site')}, {linked_sql('q', 'reason')}, {linked_sql('t', "'prepared_cohort'")},
stuck AS (SELECT coalesce((SELECT bool_or(opened AND choices = 0) FROM s_o), false) OR coalesce((SELECT bool_or(opened AND choices = 0) FROM q_o), false) AS v),
total AS (SELECT *, ok AND NOT (SELECT v FROM stuck) AS fine FROM t_k),
shown_s AS (SELECT *, ok AND NOT (free AND turn = 1 AND (opened OR (hidden = 0 AND (SELECT NOT fine FROM total)))) AS fine FROM s_o),
shown_q AS (SELECT *, ok AND NOT (free AND turn = 1 AND (opened OR (hidden = 0 AND (SELECT NOT fine FROM total)))) AS fine FROM q_o)"""


def linked_release(spark, d):
    """Site composition, exclusion reasons and their common total, screened together."""
    rows = B.records(spark, d).withColumn("reason", F.expr(REASON_SQL)).withColumn("item", F.lit("prepared_cohort"))

    def cells(key):
        per_cluster = rows.groupBy(key, "cluster_id").agg(
            F.count(F.lit(1)).alias("r"), F.sum("n_segments").alias("s"), F.sum("any_abnormal").alias("p"),
            F.count_if(F.col("any_abnormal") == 1).alias("pos"), F.count_if(F.col("any_abnormal") == 0).alias("neg"))
        return per_cluster.groupBy(key).agg(
            F.sum("r").alias("records"), F.count("cluster_id").alias("clusters"), F.coalesce(F.sum("s"), F.lit(0)).alias("segments"),
            F.coalesce(F.sum("p"), F.lit(0)).alias("positive_records"), F.count_if(F.col("pos") > 0).alias("_pc"), F.count_if(F.col("neg") > 0).alias("_qc"))

    allowed = D.enough(["clusters"], LINKED_MINIMUM) & D.empty_or_enough("_pc", LINKED_MINIMUM) & D.empty_or_enough("_qc", LINKED_MINIMUM)
    tables, total = D.screen_linked({"site": (cells("site"), "site"), "reason": (cells("reason"), "reason")}, cells("item"), LINKED, allowed, "clusters", LINKED_MINIMUM)
    return {name: df.drop("_pc", "_qc") for name, df in {**tables, "item": total}.items()}


@query("J11_linked_composition", f"WITH {LINKED_SQL} SELECT 'S' || lpad(CAST(row_number() OVER (ORDER BY cell) AS VARCHAR), 2, '0') AS alias, {shown(LINKED, 'fine')}, {STATUS.format(ok='fine')} FROM shown_s")
def linked_composition(spark, d):
    return D.pseudonymise(linked_release(spark, d)["site"], "site")


@query("J11_exclusion_reasons", f"WITH {LINKED_SQL} SELECT cell AS reason, {shown(LINKED, 'fine')}, {STATUS.format(ok='fine')} FROM shown_q")
def exclusion_reasons(spark, d):
    return linked_release(spark, d)["reason"]


@query("J11_prepared_cohort", f"WITH {LINKED_SQL} SELECT cell AS item, {shown(LINKED, 'fine')}, {STATUS.format(ok='fine')} FROM total")
def prepared_cohort(spark, d):
    return linked_release(spark, d)["item"]


@query("J12_screened_missingness", """WITH v AS (SELECT cluster_id, 'quality' AS field, quality IS NOT NULL AS seen, site FROM doc_outcomes UNION ALL SELECT cluster_id, 'long_text', n_chars > 100, site FROM doc_outcomes),
c AS (SELECT site, field, count(*) FILTER (WHERE seen) AS observed_records, count(DISTINCT CASE WHEN seen THEN cluster_id END) AS observed_clusters, count(*) FILTER (WHERE NOT seen) AS missing_records, count(DISTINCT CASE WHEN NOT seen THEN cluster_id END) AS missing_clusters FROM v GROUP BY ALL),
k AS (SELECT *, (observed_clusters = 0 OR observed_clusters >= 10) AND (missing_clusters = 0 OR missing_clusters >= 10) AS ok FROM c)
SELECT site, field, """ + shown(["observed_records", "observed_clusters", "missing_records", "missing_clusters"]) + ", " + STATUS.format(ok="ok") + " FROM k")
def screened_missingness(spark, d):
    docs = B.doc_outcomes(spark, d)
    rows = F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").isNotNull().alias("seen")), F.struct(F.lit("long_text").alias("field"), (F.col("n_chars") > 100).alias("seen")))
    long = docs.select("site", "cluster_id", F.inline(rows))
    per_cluster = long.groupBy("site", "field", "cluster_id").agg(F.count_if("seen").alias("o"), F.count_if(~F.col("seen")).alias("m"))
    table = per_cluster.groupBy("site", "field").agg(F.sum("o").alias("observed_records"), F.count_if(F.col("o") > 0).alias("observed_clusters"), F.sum("m").alias("missing_records"), F.count_if(F.col("m") > 0).alias("missing_clusters"))
    numbers = ["observed_records", "observed_clusters", "missing_records", "missing_clusters"]
    return D.apply_screen(table, numbers, D.empty_or_enough("observed_clusters") & D.empty_or_enough("missing_clusters"))


@query("J12_screened_sentinels", """WITH v AS (SELECT cluster_id, CASE WHEN y < 3 THEN 9999 WHEN y < 6 THEN -1 WHEN x = 0 THEN 0 END AS code, event_type AS field FROM samples),
c AS (SELECT field, code, count(*) AS count, count(DISTINCT cluster_id) AS clusters FROM v WHERE code IS NOT NULL GROUP BY ALL), k AS (SELECT *, bool_and(count = 0 OR count >= 40) OVER (PARTITION BY field) AS ok FROM c)
SELECT field, 'sentinel_' || code AS category, """ + shown(["count"]) + ", " + STATUS.format(ok="ok") + " FROM k")
def screened_sentinels(spark, d):
    code = F.when(F.col("y") < 3, 9999).when(F.col("y") < 6, -1).when(F.col("x") == 0, 0)
    counted = B.samples(spark, d).select(F.col("event_type").alias("field"), F.concat(F.lit("sentinel_"), code).alias("category")).where(F.col("category").isNotNull()).groupBy("field", "category").agg(F.count(F.lit(1)).alias("count"))
    return D.screen_partition(counted, ["field"], ["count"], "count", 40)


@query("J13_screened_signal_quality", f"""WITH {CONTRACT}, u AS (SELECT cluster_id, 'x' AS channel, unnest(['zeros', 'negative', 'invalid']) AS issue, unnest([x_zeros, x_negative, x_invalid]) AS affected, x_samples AS samples FROM ws
 UNION ALL SELECT cluster_id, 'y', unnest(['zeros', 'negative', 'invalid']), unnest([y_zeros, y_negative, y_invalid]), y_samples FROM ws),
c AS (SELECT channel, issue, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(affected) AS BIGINT) AS affected_samples, round(sum(affected) / sum(samples)::DOUBLE, 6) AS fraction, count(DISTINCT cluster_id) AS clusters,
 count(DISTINCT CASE WHEN affected = 0 THEN cluster_id END) AS zc, count(DISTINCT CASE WHEN affected > 0 THEN cluster_id END) AS nc FROM u GROUP BY ALL),
k AS (SELECT *, clusters >= 10 AND (zc = 0 OR zc >= 10) AND (nc = 0 OR nc >= 10) AS ok FROM c) SELECT channel, issue, {shown(['samples', 'affected_samples', 'fraction'])}, {STATUS.format(ok='ok')} FROM k""")
def screened_signal_quality(spark, d):
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("issue"), F.col(f"{c}_{i}").alias("affected"), F.col(f"{c}_samples").alias("samples")) for c in "xy" for i in ("zeros", "negative", "invalid")])
    long = window_stats(spark, d).select("cluster_id", F.inline(rows))
    per_cluster = long.groupBy("channel", "issue", "cluster_id").agg(F.sum("samples").alias("s"), F.sum("affected").alias("a"), F.count_if(F.col("affected") == 0).alias("z"), F.count_if(F.col("affected") > 0).alias("nz"))
    table = per_cluster.groupBy("channel", "issue").agg(F.sum("s").alias("samples"), F.sum("a").alias("affected_samples"), V.ratio(F.sum("a"), F.sum("s")).alias("fraction"), F.count(F.lit(1)).alias("_c"),
                                                        F.count_if(F.col("z") > 0).alias("_z"), F.count_if(F.col("nz") > 0).alias("_n"))
    ok = D.enough(["_c"]) & D.empty_or_enough("_z") & D.empty_or_enough("_n")
    return rounded(D.apply_screen(table, ["samples", "affected_samples", "fraction"], ok).drop("_c", "_z", "_n"), "fraction")


SHOWN_ENDS = [f"{m}{end}" for m in M.EVALUATION_METRICS for end in ("", "_lo", "_hi")]
ALARM_ENDS = tuple(f"{m}{end}" for m in ("normal_record_alarm_rate", "false_alarms_per_normal_hour") for end in ("", "_lo", "_hi"))
ENDS_SQL = ", ".join(f"round(max({end}) FILTER (WHERE metric = '{m}'), 6) AS {m}_{end}" for m in M.EVALUATION_METRICS for end in ("lo", "hi"))
ALARM_OK = CLASS_OK.replace("negative_clusters", "negative_clusters, normal_clusters, normal_alarm_clusters, normal_quiet_clusters")


@query("J14_screened_metric_intervals", f"""WITH {WEIGHTS}, {replicate_sql('preds', 'model', 'score >= 0.5')}, {evaluation_sql('preds', 'model', 'score >= 0.5')},
ci AS (SELECT model, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM reps GROUP BY ALL), wide AS (SELECT model, {ENDS_SQL} FROM ci GROUP BY model)
SELECT model, {shown(["n", "clusters", *[c for c in SHOWN_ENDS if c not in ALARM_ENDS]], CLASS_OK)}, {shown(ALARM_ENDS, ALARM_OK)}, {STATUS.format(ok=CLASS_OK)} FROM evaluated JOIN wide USING (model)""")
def screened_intervals(spark, d):
    point = M.evaluate(fixed_threshold(spark, d), ["model"], M.at_or_above())
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    wide = screened_ends(spark, d).groupBy("model").agg(*[pick(m, c) for m in M.EVALUATION_METRICS for c in ("lo", "hi")])
    screened = D.screen_alarm_metrics(point.join(wide, "model"), ["n", "clusters", *SHOWN_ENDS], ALARM_ENDS)
    return rounded(screened.select("model", "n", "clusters", *SHOWN_ENDS, "review_status"), *SHOWN_ENDS)
