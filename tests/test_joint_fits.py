import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstat.operators import joint_logistic as J, models as T, splits as S


def plain(v, y, c=1.0, standardise=True):
    """Weights on filled values and the intercept, by gradient descent's fixed point: full Newton steps on one matrix."""
    v = np.where(np.isnan(v), np.nan_to_num(np.nanmedian(v, axis=0)), v)
    mean, spread = (v.mean(0), v.std(0, ddof=1)) if standardise else (np.zeros(v.shape[1]), np.ones(v.shape[1]))
    spread = np.where(spread > 0, spread, np.inf)
    z = np.column_stack([np.ones(len(y)), (v - mean) / spread])
    shrink = np.diag([0.0] + [1 / c] * v.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z.T * (p * (1 - p))) @ z + shrink, z.T @ (p - y) + shrink @ b)
    return b[1:] / spread, b[0] - (b[1:] / spread) @ mean


def table(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.gauss(1000, 3), rng.gauss(0, 1)
        hole = rng.random() < 0.1
        rows.append((i, [a, None if hole else b, 7.0], sorted(rng.sample(range(5), rng.randrange(4))), int(a - 1000 + 2 * b + rng.gauss(0, 2) > 0)))
    return rows, spark.createDataFrame(rows, "id int, x array<double>, use array<int>, target int").repartition(5)


def test_every_model_equals_its_own_fit(spark):
    rows, df = table(spark)
    columns = [[0, 1], [1], [2, 0], [0, 1, 2], [1]]
    models = J.fit(df, columns)
    for m, own in enumerate(columns):
        mine = [r for r in rows if m in r[2]]
        v = np.array([[np.nan if r[1][k] is None else r[1][k] for k in own] for r in mine])
        weights, start = plain(v, np.array([r[3] for r in mine]))
        assert models[m].rows == len(mine)
        assert models[m].weights == pytest.approx(weights, abs=1e-7) and models[m].intercept == pytest.approx(start, abs=1e-4)
    scored = df.select("id", F.explode("use").alias("m"), "x").select("id", "m", J.score(models, F.col("m")).alias("p"))
    by_id = {r[0]: r for r in rows}
    for r in scored.collect():
        fitted = models[r["m"]]
        v = [fitted.fill[i] if by_id[r["id"]][1][k] is None else by_id[r["id"]][1][k] for i, k in enumerate(fitted.columns)]
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-(np.dot(v, fitted.weights) + fitted.intercept))), abs=1e-9)


def test_same_as_the_single_pipeline(spark):
    _, df = table(spark)
    wide = df.select("id", "target", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    single = {r["id"]: r["score"] for r in T.predict(T.logistic(wide, ["a", "b"]), wide).collect()}
    [model] = J.fit(df.withColumn("use", F.lit([0])), [[0, 1]])
    joint = {r["id"]: r["p"] for r in df.select("id", J.score([model], F.lit(0)).alias("p")).collect()}
    assert max(abs(single[i] - joint[i]) for i in single) < 1e-4


def test_models_that_cannot_be_fitted(spark):
    schema = "x array<double>, use array<int>, target int"
    df = spark.createDataFrame([([1.0], [0, 1], 1), ([2.0], [1], 0), ([3.0], None, 1), ([None], [1], 1), ([9.0], [1], None)], schema)
    none, some, absent = J.fit(df, [[0], [0], [0]])
    assert none is None and absent is None and some.rows == 3 and some.fill[0] == 1.5
    assert J.fit(spark.createDataFrame([], schema), [[0]]) == [None]
    assert [r[0] for r in df.select(J.score([none, some], F.lit(0))).collect()] == [None] * 5


def cohort(spark):
    rng = random.Random(9)
    rows = []
    for c in range(90):
        sites = [c % 4] if c % 10 else [c % 4, (c + 1) % 4]
        for k in range(6):
            x = rng.gauss(0, 1)
            rows.append((len(rows), f"c{c}", sites[k % len(sites)], int(x + rng.gauss(0, 1.5) > 0.3), x))
    rows += [(1000 + k, f"one{k}", 8, 1, 0.5) for k in range(3)] + [(2000, None, 2, 0, 0.1), (2001, "c3", None, 1, 0.2)]
    return spark.createDataFrame(rows, "record_id long, cluster_id string, site int, target int, m1 double")


def test_roles_equal_explicit_exclusion_and_folds(spark):
    df = cohort(spark)
    roles, plan = T.loso_roles(df, [0, 1, 2, 3, 8])
    found = {r["cluster_id"]: r for r in roles.collect()}
    known = df.where("cluster_id IS NOT NULL")
    for at, site in enumerate([0, 1, 2, 3, 8]):
        away = known.join(known.where(F.col("site") == site).select("cluster_id").distinct(), "cluster_id", "left_anti")
        extra = df.where("cluster_id IS NULL") if site != 2 else df.limit(0)
        folds = {r["cluster_id"]: r["fold"] for r in S.group_folds(away.unionByName(extra), 5, 42).collect()}
        assert folds == {c: 0 if at in r["tune"] else folds.get(c) for c, r in found.items() if at in r["tune"] or at in r["use"]}
    status = {r["site"]: r["status"] for r in plan.collect()}
    assert status == {0: "ok", 1: "ok", 2: "ok", 3: "ok", 8: "insufficient_classes_or_groups"}


def test_all_sites_held_out_once(spark):
    df = cohort(spark)
    scored, plan = T.loso_scores(df, ["m1"])
    got = scored.collect()
    assert sorted(r["record_id"] for r in got if r["arm"] == "raw") == sorted(r["record_id"] for r in df.where("site < 8").collect())
    rows = df.collect()
    for site in (0, 3):
        own = {r["cluster_id"] for r in rows if r["site"] == site}
        away = df.where(~F.col("cluster_id").isin(*own) | F.col("cluster_id").isNull())
        folds = {r["cluster_id"]: r["fold"] for r in S.group_folds(away, 5, 42).collect()}
        mine = [r for r in rows if r["cluster_id"] in folds]
        v = lambda part: np.array([[r["m1"]] for r in part])
        y = lambda part: np.array([r["target"] for r in part])
        train, val = [r for r in mine if folds[r["cluster_id"]]], [r for r in mine if not folds[r["cluster_id"]]]
        held = [r for r in rows if r["site"] == site]
        w, b = plain(v(train), y(train))
        a, k = plain(v(val) * w[0] + b, y(val), standardise=False)
        linear = {r["record_id"]: r["m1"] * w[0] + b for r in held}
        for r in got:
            if r["site"] == site:
                z = linear[r["record_id"]]
                assert r["score"] == pytest.approx(1 / (1 + np.exp(-(z if r["arm"] == "raw" else a[0] * z + k))), abs=1e-7)
                assert r["monotone_increasing"] == (a[0] > 0)
    metrics, bins, plan = T.loso_evaluate(df, ["m1"])
    found = {(r["site"], r["arm"]): r for r in metrics.collect()}
    assert set(found) == {(s, arm) for s in range(4) for arm in ("raw", "platt")} | {(8, None)}
    assert found[8, None]["status"] == "insufficient_classes_or_groups" and found[8, None]["auroc"] is None and found[8, None]["n"] == 3
    counts = {(r["site"], r["arm"]): r["n"] for r in bins.groupBy("site", "arm").agg(F.sum("n").alias("n")).collect()}
    assert counts == {k: r["n"] for k, r in found.items() if k[1]}


def test_no_site_can_be_judged(spark):
    df = cohort(spark).where("site = 8")
    metrics, bins, plan = T.loso_evaluate(df, ["m1"])
    assert [r["status"] for r in metrics.collect()] == ["insufficient_classes_or_groups"] and bins.collect() == []
    assert plan.first()["development_clusters"] == 0
    empty, no_bins, no_plan = T.loso_evaluate(df.limit(0), ["m1"])
    assert empty.collect() == [] and no_bins.collect() == [] and no_plan.collect() == []


def test_a_missing_fold_makes_metrics_unavailable(spark):
    df = cohort(spark).where("cluster_id IS NOT NULL AND site < 8")
    scores = df.select("record_id", "cluster_id", "target", F.col("m1").alias("score"), F.lit(0.0).alias("alarm_above"))
    fold = F.crc32("cluster_id") % 5
    cases = {"whole": scores, "dropped": scores.where(fold != 0), "blank": scores.withColumn("score", F.when(fold != 0, F.col("score"))),
             "twice": scores.unionByName(scores.where("record_id = 7")), "foreign": scores.unionByName(scores.where("record_id = 7").withColumn("record_id", F.lit(-1)))}
    oof = None
    for arm, rows in cases.items():
        rows = rows.withColumn("arm", F.lit(arm))
        oof = rows if oof is None else oof.unionByName(rows)
    found = {r["arm"]: r for r in T.oof_metrics(df, oof, ["record_id"], ["arm"]).collect()}
    n = df.count()
    assert {a: r["status"] for a, r in found.items()} == {"whole": "ok", "dropped": "unavailable", "blank": "unavailable", "twice": "unavailable", "foreign": "unavailable"}
    assert found["whole"]["expected"] == found["whole"]["scored"] == n and found["whole"]["auroc"] is not None
    assert found["twice"]["scored"] == n - 1 and found["foreign"]["scored"] == n
    assert all(found[a]["auroc"] is None and found[a]["n"] is None for a in found if a != "whole")


def test_all_folds_and_arms_of_an_increment_in_one_fit(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.gauss(3, 1), rng.gauss(0, 1)
        rows.append((i, f"c{i % 90}", int(a - 3 + b + rng.gauss(0, 2) > 0), a, b if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "record_id long, cluster_id string, target int, a double, b double")
    fits = []
    real = J.fit
    monkeypatch.setattr(J, "fit", lambda rows, columns: fits.append(columns) or real(rows, columns))
    held, tuned = T.incremental_scores(df, ["a"], ["b"], 3)
    assert fits == [[[0], [0, 1]] * 3]
    role = {(r["outer_fold"], r["cluster_id"]): r["role"] for r in S.nested_folds(df, 3, 3, 42).collect()}
    got = {r["record_id"]: r for r in held.collect()}
    assert sorted(got) == list(range(600))
    assert tuned.count() == sum(role[f, r[1]] == "tune" for f in range(3) for r in rows)
    matrix = lambda part, k: np.array([[np.nan if v is None else v for v in r[3:4 + k]] for r in part])
    for fold in range(3):
        train = [r for r in rows if role[fold, r[1]] == "fit"]
        for k, arm in enumerate(T.ARMS):
            w, start = plain(matrix(train, k), np.array([r[2] for r in train]))
            fill = np.nanmedian(matrix(train, k), axis=0)
            for r in rows:
                if role[fold, r[1]] == "hold":
                    v = matrix([r], k)[0]
                    assert got[r[0]]["fold"] == fold
                    assert got[r[0]][arm] == pytest.approx(1 / (1 + np.exp(-(np.where(np.isnan(v), fill, v) @ w + start))), abs=1e-6)
    metrics = {r["arm"]: r for r in T.incremental_metrics(df, held, tuned).collect()}
    assert set(metrics) == set(T.ARMS) and all(r["status"] == "ok" and r["n"] == 600 and 0 < r["sensitivity"] < 1 for r in metrics.values())


def test_a_fold_with_one_class_scores_that_class(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 30, int(i % 2), float(i)) for i in range(90)], "record_id long, cluster_id long, target int, a double")
    real = J.fit
    monkeypatch.setattr(J, "fit", lambda rows, columns: [None, *real(rows, columns)[1:]])
    monkeypatch.setattr(T, "materialize", lambda rows, label: rows.withColumn("target", F.lit(1)) if label == "rows" else rows)
    held, _ = T.incremental_scores(df, ["a"], [], 3)
    assert {r["base"] for r in held.collect()} == {1.0}
