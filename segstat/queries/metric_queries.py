"""Splits (F), metrics (G) and the flagship report over the scored units."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosure as D, metrics as M, splits as S
from ..plans.ordering import spread_large
from ..sources import bindings as B
from ..sources.scratch import materialize
from .registry import query


def curve_sql(source: str, by: str, extra: str = "") -> str:
    """CTEs 'points' and 'curve' for rows of a source grouped by the columns."""
    return f"""points AS (SELECT {by}, score, sum(target) AS pos, sum(1 - target) AS neg FROM {source} {extra} GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n
          FROM points WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""


AUROC = "sum(neg * (2 * tp - pos) / 2.0::DOUBLE) / nullif(max(p)::DOUBLE * max(n), 0)"
AUPRC = "sum(pos * (tp::DOUBLE / (tp + fp))) / nullif(max(p), 0)"
SENS90 = "coalesce(max(CASE WHEN fp::DOUBLE / n <= 0.1 + 1e-12 THEN tp::DOUBLE / p END), 0.0)"


def rounded(df, *columns, digits=6):
    # Brier scores sit on a coarse lattice that meets exact halves at 6 digits, hence 7.
    return df.select(*[F.round(c, 7 if c == "brier" else digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def long_scores(spark, d):
    return B.by_model(B.scored(spark, d))


def fixed_threshold(spark, d, threshold=0.5):
    return long_scores(spark, d).withColumn("threshold", F.lit(threshold))


# --- F: splits -------------------------------------------------------------

FOLDS = """strata AS (SELECT cluster_id, max(target) AS stratum FROM predictions GROUP BY 1),
folds AS (SELECT cluster_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}|' || cluster_id)) - 1) % {k} AS INTEGER) AS fold FROM strata)"""
SPLIT = FOLDS.format(seed=42, k=10) + """,
inner_folds AS (SELECT cluster_id, (row_number() OVER (PARTITION BY stratum ORDER BY md5('43|' || cluster_id)) - 1) % 9 AS f FROM folds WHERE fold <> 0),
split AS (SELECT cluster_id, 'test' AS split FROM folds WHERE fold = 0
          UNION ALL SELECT cluster_id, CASE WHEN f = 0 THEN 'val' ELSE 'train' END FROM inner_folds)"""


@query("F01_group_folds", f"WITH {FOLDS.format(seed=42, k=5)} SELECT * FROM folds")
def group_folds(spark, d):
    return S.group_folds(B.scored(spark, d), 5, 42)


@query("F02_holdout_split", f"WITH {SPLIT} SELECT * FROM split")
def holdout_split(spark, d):
    return S.holdout_split(B.scored(spark, d))


def prior_clusters(spark, d):
    """Clusters whose balance is negative stand in for a list of clusters used before."""
    return B.table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("cluster_id"))


PRIOR = """prior AS (SELECT c_custkey AS cluster_id FROM customer WHERE c_acctbal < 0),
strata AS (SELECT cluster_id, max(target) AS stratum FROM predictions WHERE cluster_id NOT IN (SELECT cluster_id FROM prior) GROUP BY 1),
folds AS (SELECT cluster_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || cluster_id)) - 1) % 10 AS fold FROM strata),
inner_folds AS (SELECT cluster_id, (row_number() OVER (PARTITION BY stratum ORDER BY md5('43|' || cluster_id)) - 1) % 9 AS f FROM folds WHERE fold <> 0),
split AS (SELECT cluster_id, 'test' AS split, false AS prior_seen FROM folds WHERE fold = 0
          UNION ALL SELECT cluster_id, CASE WHEN f = 0 THEN 'val' ELSE 'train' END, false FROM inner_folds
          UNION ALL SELECT DISTINCT cluster_id, 'train', true FROM predictions WHERE cluster_id IN (SELECT cluster_id FROM prior))"""


@query("F03_split_with_prior", f"WITH {PRIOR} SELECT * FROM split")
def split_with_prior(spark, d):
    return S.split_with_prior(B.scored(spark, d), prior_clusters(spark, d))


@query("F04_nested_folds", f"""WITH {FOLDS.format(seed=42, k=5)},
copies AS (SELECT * FROM folds CROSS JOIN (SELECT CAST(range AS INTEGER) AS outer_fold FROM range(5))),
pool AS (SELECT outer_fold, cluster_id, (row_number() OVER (PARTITION BY outer_fold, stratum ORDER BY md5('42|' || outer_fold || '|' || cluster_id)) - 1) % 4 AS f
         FROM copies WHERE fold <> outer_fold)
SELECT outer_fold, cluster_id, 'hold' AS role FROM copies WHERE fold = outer_fold
UNION ALL SELECT outer_fold, cluster_id, CASE WHEN f = 0 THEN 'tune' ELSE 'fit' END FROM pool""")
def nested_folds(spark, d):
    return S.nested_folds(B.scored(spark, d), 5, 4, 42)


@query("F05_loso_plan", """WITH pair AS (SELECT site, cluster_id, count(*) AS r, sum(target) AS p FROM predictions GROUP BY ALL),
cl AS (SELECT cluster_id, sum(r) AS r, sum(p) AS p FROM pair GROUP BY 1),
tot AS (SELECT sum(r) AS r, sum(p) AS p, count(*) AS c FROM cl),
plan AS (SELECT site, CAST(sum(pair.r) AS BIGINT) AS held_rows, count(*) AS held_clusters, CAST(sum(pair.p) AS BIGINT) AS held_positives,
  CAST(max(tot.r) - sum(cl.r) AS BIGINT) AS development_rows, max(tot.c) - count(*) AS development_clusters, CAST(max(tot.p) - sum(cl.p) AS BIGINT) AS development_positives
  FROM pair JOIN cl USING (cluster_id) CROSS JOIN tot GROUP BY site)
SELECT *, CASE WHEN held_positives BETWEEN 1 AND held_rows - 1 AND development_positives BETWEEN 1 AND development_rows - 1 AND development_clusters >= 8
  THEN 'ok' ELSE 'insufficient_classes_or_groups' END AS status FROM plan""")
def loso_plan(spark, d):
    return S.loso_plan(B.scored(spark, d))


def split_rows(spark, d, rows=None):
    rows = B.scored(spark, d) if rows is None else rows
    return S.assign(rows, S.holdout_split(B.scored(spark, d)))


@query("F06_split_summary", f"""WITH {SPLIT} SELECT split, count(DISTINCT record_id) AS records, count(DISTINCT cluster_id) AS clusters,
count(*) AS segments, CAST(sum(target) AS BIGINT) AS positives FROM predictions JOIN split USING (cluster_id) GROUP BY split""")
def split_summary(spark, d):
    return S.split_summary(split_rows(spark, d))


@query("F07_leakage_audit", """WITH naive AS (SELECT cluster_id, CASE WHEN record_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM predictions)
SELECT cluster_id, count(DISTINCT split) AS n_splits FROM naive GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage(spark, d):
    """Audits a split made by record instead of by cluster: it leaks."""
    naive = B.scored(spark, d).withColumn("split", F.when(F.col("record_id") % 5 == 0, "test").otherwise("train"))
    return S.leakage(naive)


@query("F08_cohort_history", f"""WITH {PRIOR} SELECT count(*) AS supplied_clusters, count(split) AS matched_clusters,
count(*) FILTER (WHERE split = 'val') AS matched_validation_clusters, count(*) FILTER (WHERE split = 'test') AS matched_test_clusters
FROM prior LEFT JOIN split USING (cluster_id)""")
def cohort_history(spark, d):
    prior = prior_clusters(spark, d)
    return S.cohort_history(S.split_with_prior(B.scored(spark, d), prior), prior)


@query("F09_sample_rows", """SELECT record_id, seg_idx, target FROM predictions ORDER BY md5('42|' || record_id || '|' || seg_idx) LIMIT 100""")
def sample_n(spark, d):
    return S.sample_n(B.predictions(spark, d).select("record_id", "seg_idx", "target"), 100, 42, ["record_id", "seg_idx"])


@query("F10_two_class_guard", f"""WITH {SPLIT} SELECT split, site, CASE WHEN min(target) = 0 AND max(target) = 1 THEN 'ok' ELSE 'insufficient_classes' END AS status
FROM predictions JOIN split USING (cluster_id) GROUP BY ALL""")
def two_class_guard(spark, d):
    return S.require_two_classes(split_rows(spark, d), ["split", "site"])


# --- G: metrics ------------------------------------------------------------

CURVE = "WITH " + curve_sql("preds", "model")


@query("G01_auroc", f"{CURVE} SELECT model, round({AUROC}, 6) AS auroc FROM curve GROUP BY model")
def auroc(spark, d):
    return rounded(M.auroc(long_scores(spark, d), ["model"]), "auroc")


@query("G01_auroc_weighted", """WITH points AS (SELECT model, score, sum((1 + cluster_id % 3) * target) AS pos, sum((1 + cluster_id % 3) * (1 - target)) AS neg FROM preds GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
 FROM points WINDOW w AS (PARTITION BY model ORDER BY score DESC))
""" + f"SELECT model, round({AUROC}, 6) AS auroc, round({AUPRC}, 6) AS auprc FROM curve GROUP BY model")
def auroc_weighted(spark, d):
    ranked = M.ranking(long_scores(spark, d), ["model"], weight=1 + F.col("cluster_id") % 3)
    return rounded(ranked.drop("sensitivity_at_spec90"), "auroc", "auprc")


@query("G02_average_precision", f"{CURVE} SELECT model, round({AUPRC}, 6) AS auprc FROM curve GROUP BY model")
def average_precision(spark, d):
    return rounded(M.average_precision(long_scores(spark, d), ["model"]), "auprc")


OPERATING = """count(*) FILTER (WHERE target = 1 AND alarm) / nullif(sum(target), 0)::DOUBLE AS sensitivity,
1 - count(*) FILTER (WHERE target = 0 AND alarm) / nullif(sum(1 - target), 0)::DOUBLE AS specificity,
count(*) FILTER (WHERE target = 1 AND alarm) / nullif(count(*) FILTER (WHERE alarm), 0)::DOUBLE AS ppv,
2 * count(*) FILTER (WHERE target = 1 AND alarm) / (sum(target) + count(*) FILTER (WHERE alarm))::DOUBLE AS f1,
sum(target) / count(*)::DOUBLE AS prevalence"""
R5 = "round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(ppv, 6) AS ppv, round(f1, 6) AS f1, round(prevalence, 6) AS prevalence"


@query("G03_operating_point", f"""WITH a AS (SELECT *, score >= 0.5 AS alarm FROM preds), o AS (SELECT model, {OPERATING} FROM a GROUP BY model)
SELECT model, {R5} FROM o""")
def operating_point(spark, d):
    rows = fixed_threshold(spark, d)
    return rounded(M.operating_point(rows, ["model"], M.at_or_above()), "sensitivity", "specificity", "ppv", "f1", "prevalence")


@query("G04_brier", "SELECT model, round(avg((score - target) * (score - target)), 7) AS brier FROM preds GROUP BY model")
def brier(spark, d):
    return rounded(M.brier(long_scores(spark, d), ["model"]), "brier")


@query("G05_sensitivity_at_specificity", f"{CURVE} SELECT model, round({SENS90}, 6) AS sensitivity_at_spec90 FROM curve GROUP BY model")
def sens_at_spec(spark, d):
    return rounded(M.sens_at_spec(long_scores(spark, d), ["model"]), "sensitivity_at_spec90")


THRESHOLD = """neg AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) AS k, count(*) OVER (PARTITION BY model) AS n
 FROM preds JOIN split USING (cluster_id) WHERE split = 'val' AND target = 0),
thr AS (SELECT model, min(score) FILTER (WHERE k >= ceil(0.9::DOUBLE * n)) AS alarm_above FROM neg GROUP BY model)"""


@query("G06_threshold90", f"WITH {SPLIT}, {THRESHOLD} SELECT model, round(alarm_above, 6) AS alarm_above FROM thr")
def threshold90(spark, d):
    validation = S.assign(long_scores(spark, d), S.holdout_split(B.scored(spark, d)).where(F.col("split") == "val"))
    return rounded(M.threshold90(validation, ["model"]), "alarm_above")


NORMAL = """a AS (SELECT model, record_id, max(target) AS any_pos, count(*) AS segs, count(*) FILTER (WHERE score >= 0.9) AS alarms FROM preds GROUP BY ALL)"""


@query("G07_normal_record_alarm_rate", f"""WITH {NORMAL} SELECT model, count(*) AS normal_records, count(*) FILTER (WHERE alarms > 0) AS normal_records_alarmed,
round(count(*) FILTER (WHERE alarms > 0) / count(*)::DOUBLE, 6) AS normal_record_alarm_rate FROM a WHERE any_pos = 0 GROUP BY model""")
def normal_record_alarm_rate(spark, d):
    rows = fixed_threshold(spark, d, 0.9)
    return rounded(M.normal_record_alarm_rate(rows, ["model"], M.at_or_above()), "normal_record_alarm_rate")


@query("G08_false_alarms_per_hour", f"""WITH {NORMAL} SELECT model, round(sum(alarms) / (sum(segs) / 12::DOUBLE), 6) AS false_alarms_per_normal_hour FROM a WHERE any_pos = 0 GROUP BY model""")
def false_alarms_per_hour(spark, d):
    rows = fixed_threshold(spark, d, 0.9)
    return rounded(M.false_alarms_per_hour(rows, ["model"], M.at_or_above()), "false_alarms_per_normal_hour")


COHORT = """count(*) AS n, count(DISTINCT cluster_id) AS clusters, CAST(sum(target) AS BIGINT) AS positives,
count(DISTINCT CASE WHEN target = 1 THEN cluster_id END) AS positive_clusters, count(DISTINCT CASE WHEN target = 0 THEN cluster_id END) AS negative_clusters"""


@query("G09_cohort_counts", f"SELECT site, {COHORT} FROM predictions GROUP BY site")
def cohort_counts(spark, d):
    return M.cohort_counts(B.scored(spark, d), ["site"])


def evaluation_sql(source: str, by: str, alarm: str) -> str:
    """CTE 'evaluated' holding every point metric per group."""
    on = " AND ".join(f"g.{c.strip()} IS NOT DISTINCT FROM k.{c.strip()}" for c in by.split(","))
    on_normal = on.replace("k.", "h.")
    keys = ", ".join(f"g.{c.strip()}" for c in by.split(","))
    return f"""{curve_sql(source, by)},
rank_metrics AS (SELECT {by}, {AUROC} AS auroc, {AUPRC} AS auprc, {SENS90} AS sens90 FROM curve GROUP BY {by}),
alarmed AS (SELECT *, {alarm} AS alarm FROM {source}),
rec AS (SELECT {by}, cluster_id, record_id, max(target) AS any_pos, count(*) AS segs, count(*) FILTER (WHERE alarm) AS alarms FROM alarmed GROUP BY ALL),
normal AS (SELECT {by}, count(*) AS nr, count(*) FILTER (WHERE alarms > 0) AS nra, sum(segs) AS ns, sum(alarms) AS na,
  count(DISTINCT cluster_id) AS normal_clusters, count(DISTINCT CASE WHEN alarms > 0 THEN cluster_id END) AS normal_alarm_clusters
  FROM rec WHERE any_pos = 0 GROUP BY {by}),
g AS (SELECT {by}, {COHORT}, {OPERATING}, avg((score - target) * (score - target)) AS brier FROM alarmed GROUP BY {by}),
evaluated AS (SELECT {keys}, CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN 'ok' ELSE 'insufficient_classes' END AS status,
  g.n, clusters, positives, positive_clusters, negative_clusters, coalesce(normal_clusters, 0) AS normal_clusters,
  coalesce(normal_alarm_clusters, 0) AS normal_alarm_clusters, coalesce(normal_clusters - normal_alarm_clusters, 0) AS normal_quiet_clusters,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(auroc, 6) END AS auroc, CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(auprc, 6) END AS auprc,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(sens90, 6) END AS sensitivity_at_spec90,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(prevalence, 6) END AS prevalence,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(sensitivity, 6) END AS sensitivity, CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(specificity, 6) END AS specificity,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(ppv, 6) END AS ppv, CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(f1, 6) END AS f1,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(brier, 7) END AS brier,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(nra / nr::DOUBLE, 6) END AS normal_record_alarm_rate,
  CASE WHEN positives BETWEEN 1 AND g.n - 1 THEN round(na / (ns / 12::DOUBLE), 6) END AS false_alarms_per_normal_hour
  FROM g JOIN rank_metrics k ON {on} LEFT JOIN normal h ON {on_normal})"""


EVALUATED = ", ".join(["status", "n", "clusters", "positives", "positive_clusters", "negative_clusters", "normal_clusters", "normal_alarm_clusters",
                       "normal_quiet_clusters", *M.EVALUATION_METRICS])


@query("G10_evaluate", f"WITH {evaluation_sql('preds', 'model', 'score >= 0.5')} SELECT model, {EVALUATED} FROM evaluated")
def evaluate(spark, d):
    return rounded(M.evaluate(fixed_threshold(spark, d), ["model"], M.at_or_above()), *M.EVALUATION_METRICS)


@query("G10_evaluate_by_site", f"WITH {evaluation_sql('preds', 'model, site', 'score >= 0.8')} SELECT model, site, {EVALUATED} FROM evaluated")
def evaluate_by_site(spark, d):
    return rounded(M.evaluate(fixed_threshold(spark, d, 0.8), ["model", "site"], M.at_or_above()), *M.EVALUATION_METRICS)


@query("G14_roc_points", f"{CURVE} SELECT model, round(score, 6) AS score, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM curve")
def roc_points(spark, d):
    return rounded(M.roc_points(long_scores(spark, d), ["model"]), "score", "fpr", "tpr")


@query("G14_pr_points", f"{CURVE} SELECT model, round(score, 6) AS score, round(tp / p::DOUBLE, 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision FROM curve")
def pr_points(spark, d):
    return rounded(M.pr_points(long_scores(spark, d), ["model"]), "score", "recall", "precision")


@query("G15_roc_grid", """WITH t AS (SELECT range / 20::DOUBLE AS threshold FROM range(21)),
c AS (SELECT model, score, sum(target) AS pos, sum(1 - target) AS neg FROM preds GROUP BY ALL),
s AS (SELECT model, threshold, sum(pos) AS p, sum(neg) AS n, coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) AS tp, coalesce(sum(neg) FILTER (WHERE score >= threshold), 0) AS fp
      FROM c CROSS JOIN t GROUP BY ALL)
SELECT model, threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS recall, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision FROM s""")
def roc_grid(spark, d):
    return rounded(M.roc_grid(long_scores(spark, d), ["model"]), "fpr", "recall", "precision")


BIN10 = "CAST(least(max(k), 9) AS INTEGER)"


@query("G16_calibration", """WITH e AS (SELECT CAST(range AS INTEGER) AS bin, range / 10::DOUBLE AS lo, (range + 1) / 10::DOUBLE AS hi FROM range(10))
SELECT model, bin, count(*) AS n, round(avg(score), 6) AS mean_prediction, round(avg(target), 6) AS observed
FROM preds JOIN e ON score >= lo AND (score < hi OR (bin = 9 AND score <= 1)) GROUP BY ALL""")
def calibration(spark, d):
    return rounded(M.calibration(long_scores(spark, d), ["model"]), "mean_prediction", "observed")


@query("G17_confusion", """WITH grid AS (SELECT DISTINCT model, actual, predicted FROM preds, (SELECT unnest([0, 1]) AS actual), (SELECT unnest([0, 1]) AS predicted)),
c AS (SELECT model, target AS actual, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS segments, count(DISTINCT cluster_id) AS clusters FROM preds GROUP BY ALL)
SELECT model, actual, predicted, coalesce(segments, 0) AS segments, coalesce(clusters, 0) AS clusters FROM grid LEFT JOIN c USING (model, actual, predicted)""")
def confusion(spark, d):
    return M.confusion(fixed_threshold(spark, d), ["model"], M.at_or_above())


@query("G18_score_histogram", """WITH e AS (SELECT CAST(range AS INTEGER) AS bin, range / 20::DOUBLE AS lo, (range + 1) / 20::DOUBLE AS hi FROM range(20)),
c AS (SELECT model, target AS actual, bin, count(*) AS segments FROM preds JOIN e ON score >= lo AND (score < hi OR (bin = 19 AND score <= 1)) GROUP BY ALL)
SELECT *, round(segments / sum(segments) OVER (PARTITION BY model, actual)::DOUBLE, 6) AS class_fraction FROM c""")
def score_hist(spark, d):
    return rounded(M.score_hist(long_scores(spark, d), ["model"]), "class_fraction")


@query("G19_accuracy", "SELECT model, round(avg(CASE WHEN (score >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds GROUP BY model")
def accuracy(spark, d):
    return rounded(M.accuracy(long_scores(spark, d), ["model"]), "accuracy")


@query("G20_verify_metrics", f"""{CURVE}, m AS (SELECT model, round({AUROC}, 6) AS auroc, round({AUPRC}, 6) AS auprc FROM curve GROUP BY model)
SELECT model, auroc, auprc, auroc AS auroc_check, auprc AS auprc_check, true AS matches FROM m""")
def verify_metrics(spark, d):
    rows = long_scores(spark, d)
    stored = M.ranking(rows, ["model"]).select("model", "auroc", "auprc")
    return rounded(M.verify_metrics(rows, stored, ["model"]), "auroc", "auprc", "auroc_check", "auprc_check")


SUBGROUPS = """sub AS (SELECT p.*, unnest(list_filter([CASE WHEN balance < 2000 THEN 'balance_lt2000' END, CASE WHEN balance >= 2000 THEN 'balance_ge2000' END,
  CASE WHEN balance < 0 THEN 'balance_invalid' END, CASE WHEN site IS NULL THEN 'site_missing' END], lambda v: v IS NOT NULL)) AS subgroup
  FROM preds p JOIN (SELECT record_id, balance FROM records) USING (record_id))"""


@query("G22_evaluate_subgroups", f"WITH {SUBGROUPS}, {evaluation_sql('sub', 'subgroup, model', 'score >= 0.5')} SELECT subgroup, model, {EVALUATED} FROM evaluated")
def evaluate_subgroups(spark, d):
    balance = B.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_acctbal").alias("balance"))
    # Joined before every row is doubled for its two models, and dealt once for the join and the sums below it.
    scored = spread_large(B.scored(spark, d), B.table(spark, d, "lineitem").count(), "cluster_id").join(balance, "cluster_id")
    rows = B.by_model(scored).withColumn("threshold", F.lit(0.5))
    masks = {"balance_lt2000": F.col("balance") < 2000, "balance_ge2000": F.col("balance") >= 2000,
             "balance_invalid": F.col("balance") < 0, "site_missing": F.col("site").isNull()}
    return rounded(M.evaluate_by(rows, masks, ["model"], M.at_or_above()), *M.EVALUATION_METRICS)


RANKS = """v AS (SELECT site, price AS x, abnormal_fraction AS y FROM records WHERE price IS NOT NULL AND abnormal_fraction IS NOT NULL),
r AS (SELECT site, rank() OVER (PARTITION BY site ORDER BY x) + (count(*) OVER (PARTITION BY site, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY site ORDER BY y) + (count(*) OVER (PARTITION BY site, y) - 1) / 2.0::DOUBLE AS ry FROM v)"""


@query("G23_spearman", f"""WITH {RANKS} SELECT site, count(*) AS n, round(CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 6) AS spearman FROM r GROUP BY site""")
def spearman(spark, d):
    return rounded(M.spearman(B.records(spark, d), ["site"], "price", "abnormal_fraction"), "spearman")


@query("G24_mean_absolute_error", "SELECT site, round(avg(abs(m1 - m2)), 6) AS mae FROM predictions GROUP BY site")
def mae(spark, d):
    return rounded(M.mae(B.scored(spark, d), ["site"], "m1", "m2"), "mae")


# --- flagship --------------------------------------------------------------

SITE_NUMBERS = ["n", "clusters", "positives", "positive_clusters", "negative_clusters", *M.EVALUATION_METRICS]


def flagship(spark, d):
    """How well does each score rank positives per site, and how often are normal records alarmed?

    Clusters are split once; each model's alarm threshold comes from validation
    negatives; test rows are evaluated by site; small sites are suppressed and
    site names replaced.
    """
    rows = B.scored(spark, d)
    split = materialize(S.holdout_split(rows), "split")
    long = B.by_model(materialize(S.assign(rows, split.where(F.col("split") != "train")), "held"))
    thresholds = materialize(M.threshold90(long.where(F.col("split") == "val"), ["model"]), "thresholds")
    test = long.where(F.col("split") == "test").join(thresholds, "model")
    result = rounded(M.evaluate(test, ["model", "site"], F.col("score") > F.col("alarm_above")), *M.EVALUATION_METRICS)
    screened = D.screen_alarm_metrics(result, SITE_NUMBERS)
    return D.pseudonymise(screened, "site").drop("normal_clusters", "normal_alarm_clusters", "normal_quiet_clusters")


SCREENED_SQL = ", ".join(f"CASE WHEN least(clusters, positive_clusters, negative_clusters) >= 10 THEN {c} END AS {c}" for c in SITE_NUMBERS[:-2])
ALARM_SQL = ", ".join(f"CASE WHEN least(clusters, positive_clusters, negative_clusters, normal_clusters, normal_alarm_clusters, normal_quiet_clusters) >= 10 THEN {c} END AS {c}" for c in SITE_NUMBERS[-2:])
query("flagship_site_report", f"""WITH {SPLIT}, {THRESHOLD},
test AS (SELECT p.*, alarm_above FROM preds p JOIN split USING (cluster_id) JOIN thr USING (model) WHERE split = 'test'),
{evaluation_sql('test', 'model, site', 'score > alarm_above')},
names AS (SELECT site, 'S' || lpad(CAST(row_number() OVER (ORDER BY site) AS VARCHAR), 2, '0') AS alias FROM (SELECT DISTINCT site FROM evaluated))
SELECT alias, model, status, {SCREENED_SQL}, {ALARM_SQL},
CASE WHEN least(clusters, positive_clusters, negative_clusters) >= 10 THEN 'screened_aggregate_pending_review' ELSE 'suppressed_requires_review' END AS review_status
FROM evaluated JOIN names USING (site)""")(flagship)
