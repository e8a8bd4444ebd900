"""Ranking metrics, operating points and bootstrap against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from segstat.operators import bootstrap as BS, metrics as M

TARGET = [1, 0, 0, 0, 1, 0, 1, 0, 0, 1]
SCORE = [.9, .3, .6, .1, .6, .3, .3, .7, .05, .4]
CLUSTER = list("PPQQRRRSSS")
RECORD = list("ijkkllmnno")
NORMAL = [0, 1, 1, 1, 0, 0, 0, 1, 1, 0]


def frame(spark, target=TARGET, score=SCORE):
    rows = list(zip(RECORD, CLUSTER, target, [float(s) for s in score], NORMAL))
    return spark.createDataFrame(rows, "record_id string, cluster_id string, target int, score double, normal int").withColumn("g", F.lit("m"))


def brute(target, score, weight):
    """AUROC by pairs, average precision by distinct thresholds."""
    y, p, w = map(np.asarray, (target, score, weight))
    wins = sum(w[i] * w[j] * ((p[i] > p[j]) + .5 * (p[i] == p[j])) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    auc = wins / (w[y == 1].sum() * w[y == 0].sum())
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (w * y)[hit].sum() / (w * y).sum()
        ap += (recall - before) * (w * y)[hit].sum() / w[hit].sum()
        before = recall
    return auc, ap


@pytest.mark.parametrize("weights", [{"P": 1, "Q": 1, "R": 1, "S": 1}, {"P": 2, "Q": 1, "R": 0, "S": 3}, {"P": .4, "Q": .4, "R": .4, "S": .4}, {"P": .25, "Q": 1.5, "R": .7, "S": 2.0}])
def test_ranking_with_ties_and_cluster_weights(spark, weights):
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("cluster_id")]
    row = M.ranking(frame(spark), ["g"], weight=w).first()
    auc, ap = brute(TARGET, SCORE, [weights[c] for c in CLUSTER])
    assert np.isclose(row["auroc"], auc) and np.isclose(row["auprc"], ap)


def test_split_ranges_do_not_change_the_curve(spark, small_limit):
    row = M.ranking(frame(spark), ["g"]).first()
    assert np.allclose([row["auroc"], row["auprc"]], brute(TARGET, SCORE, [1] * 10))


def test_threshold_is_conservative_for_ties(spark):
    rows = [(0, .8)] * 20 + [(1, .9)] * 5
    df = spark.createDataFrame(rows, "target int, score double").withColumn("g", F.lit(1))
    limit = M.threshold90(df, ["g"]).first()["alarm_above"]
    assert sum(s > limit for t, s in rows if t == 0) <= 2 and all(s > limit for t, s in rows if t == 1)


def test_normal_record_alarms_and_hours(spark):
    df = frame(spark).withColumn("threshold", F.lit(.5))
    point = M.evaluate(df, ["g"], M.at_or_above(), normal=F.col("normal")).first()
    # Normal records j, k, n: k and n alarm, in two of five segments.
    assert np.isclose(point["normal_record_alarm_rate"], 2 / 3) and np.isclose(point["false_alarms_per_normal_hour"], 2 / (5 / 12))
    assert (point["clusters"], point["positive_clusters"], point["negative_clusters"]) == (4, 3, 4)


def test_single_class_is_a_status_not_a_number(spark):
    row = M.evaluate(frame(spark, [0] * 10), ["g"], F.col("score") >= .5).first()
    assert row["status"] == "insufficient_classes" and row["auroc"] is None and row["n"] == 10


def test_confusion_counts_and_record_alarms(spark):
    rows = [("a", "A", 0, .5), ("a", "A", 0, .4), ("b", "B", 1, .5), ("c", "C", 1, .2), ("d", "D", 0, .1)]
    df = spark.createDataFrame(rows, "record_id string, cluster_id string, target int, score double").withColumn("g", F.lit(1))
    cells = {(r["actual"], r["predicted"]): r["segments"] for r in M.confusion(df, ["g"], F.col("score") >= .5).collect()}
    assert [[cells[0, 0], cells[0, 1]], [cells[1, 0], cells[1, 1]]] == [[2, 1], [1, 1]]
    alarms = M.normal_record_alarm_rate(df, ["g"], F.col("score") >= .5).first()
    assert (alarms["normal_records_alarmed"], alarms["normal_records"]) == (1, 2)


def test_identical_arms_have_a_zero_interval(spark):
    df = frame(spark).withColumn("other", F.col("score"))
    rows = BS.paired(df, "score", "other", 20).collect()
    assert {r["metric"] for r in rows} == {"auroc", "auprc", "brier"}
    assert all(r["difference"] == 0 and r["lo"] == 0 and r["hi"] == 0 and r["n_valid"] > 0 for r in rows)


def test_weights_sum_to_the_cluster_count(spark):
    df = spark.range(37).select(F.col("id").alias("cluster_id"))
    sums = BS.cluster_weights(df, 6).groupBy("b").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 6 and all(r["w"] == 37 for r in sums)


def test_bootstrap_matches_brute_force(spark):
    df = frame(spark)
    drawn = BS.cluster_weights(df, 8).collect()
    table = {(r["b"], r["cluster_id"]): r["weight"] for r in drawn}
    values = []
    for b in range(8):
        w = [table.get((b, c), 0) for c in CLUSTER]
        if sum(x * t for x, t in zip(w, TARGET)) and sum(x * (1 - t) for x, t in zip(w, TARGET)):
            values.append(brute(TARGET, SCORE, w)[0])
    row = [r for r in BS.bootstrap_ci(df, ["g"], 8).collect() if r["metric"] == "auroc"][0]
    assert row["n_valid"] == len(values) and np.allclose([row["lo"], row["hi"]], np.quantile(values, [.025, .975]))


def every_metric(rows, weight):
    """All eleven metrics of (score, target, cluster, record, alarm) rows under cluster weights; None without both classes."""
    w = np.array([weight.get(r[2], 0) for r in rows], float)
    score, y, alarm = (np.array([r[k] for r in rows], float) for k in (0, 1, 4))
    if not (w * y).sum() or not (w * (1 - y)).sum():
        return None
    auroc, auprc = brute([r[1] for r in rows], [r[0] for r in rows], w)[:2]
    p, n, tp, fp = (w * y).sum(), (w * (1 - y)).sum(), (w * y * alarm).sum(), (w * (1 - y) * alarm).sum()
    spots = [((w * y * (score >= t)).sum() / p, (w * (1 - y) * (score >= t)).sum() / n) for t in set(score)]
    records = {}
    for (_, t, c, r, a), own in zip(rows, w):
        held = records.setdefault((c, r), [own, True, 0, 0])
        held[1] &= t == 0
        held[2] += 1
        held[3] += a
    normal = [(own, size, hits) for own, quiet, size, hits in records.values() if quiet]
    share = lambda a, b: a / b if b else None
    return {"auroc": auroc, "auprc": auprc, "prevalence": p / (p + n), "brier": (w * (score - y) ** 2).sum() / w.sum(),
            "sensitivity_at_spec90": max([t for t, f in spots if f <= .1 + 1e-12], default=0.0),
            "sensitivity": tp / p, "specificity": 1 - fp / n, "ppv": share(tp, tp + fp), "f1": 2 * tp / (p + tp + fp),
            "normal_record_alarm_rate": share(sum(o for o, _, h in normal if h), sum(o for o, _, _ in normal)),
            "false_alarms_per_normal_hour": share(sum(o * h for o, _, h in normal), sum(o * s for o, s, _ in normal) / 12)}


@pytest.mark.parametrize("held,b", [(2_000_000, 12), (30, 12), (2_000_000, 400)])
def test_all_bootstrap_metrics_match_brute_force(spark, monkeypatch, held, b):
    """Many scores over several ranges, ties, two groups of which one is NULL, and small blocks."""
    from segstat.operators import replicates
    monkeypatch.setattr(replicates, "HELD", held)
    rng = np.random.default_rng(4)
    rows = {g: [(float(rng.integers(0, top)) / top, int(rng.random() < .3), int(rng.integers(0, 23)), int(rng.integers(0, 3)), bool(rng.random() < .2)) for _ in range(260)]
            for g, top in (("m", 90), (None, 7))}
    # A record's segments share one cluster.
    table = [(g, s, t, c, f"{c}/{r}", a) for g, own in rows.items() for s, t, c, r, a in own] + [("m", None, 1, 2, "2/0", True), ("m", .5, None, 2, "2/0", True)]
    df = spark.createDataFrame(table, "model string, score double, target int, cluster_id int, record_id string, alarm boolean").repartition(5)
    usable = df.where("score IS NOT NULL AND target IS NOT NULL")
    weights = BS.cluster_weights(usable, b, 3)
    drawn = {}
    for r in weights.collect():
        drawn.setdefault(r["b"], {})[r["cluster_id"]] = r["weight"]
    got = {(r["model"], r["metric"]): r for r in BS.bootstrap_ci(usable, ["model"], alarm=F.col("alarm"), weights=weights, record="record_id").collect()}
    assert len(got) == 22
    for g, own in rows.items():
        found = [m for m in (every_metric(own, drawn[k]) for k in drawn) if m]
        for metric in found[0]:
            values = [m[metric] for m in found if m[metric] is not None]
            r = got[(g, metric)]
            assert r["n_valid"] == len(values) and np.allclose([r["lo"], r["hi"]], np.quantile(values, [.025, .975])), (g, metric)


def test_reversed_contrast_swaps_ends(spark):
    df = spark.createDataFrame([("a", "b", .2, -.1, .3)], "left_model string, right_model string, difference double, lo double, hi double")
    row = M.reverse_contrast(df).first()
    assert (row["left_model"], row["difference"], row["lo"], row["hi"]) == ("b", -.2, -.3, .1)


def test_spearman_is_null_when_constant(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, 1.0), (2, 2.0, 5.0), (2, 3.0, 4.0)], "g int, x double, y double")
    got = {r["g"]: r["spearman"] for r in M.spearman(df, ["g"], "x", "y").collect()}
    assert got[1] is None and np.isclose(got[2], .5)


def test_scores_that_are_not_numbers_are_reported_not_ranked(spark):
    odd = [(0, float("nan")), (1, float("inf")), (1, None), (None, .5), (0, float("-inf"))]
    good = list(zip(TARGET, SCORE))
    df = spark.createDataFrame([("m", t, s) for t, s in good + odd], "g string, target int, score double")
    row = M.ranking(df, ["g"]).first()
    assert np.allclose([row["auroc"], row["auprc"]], brute(TARGET, SCORE, [1] * 10))
    assert M.invalid_scores(df, ["g"]).first().asDict() == {"g": "m", "rows": 15, "invalid_rows": 5}
