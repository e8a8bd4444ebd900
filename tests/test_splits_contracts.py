"""Splits without leakage, whole-record contracts, sources."""
import pytest
from pyspark.sql import functions as F

from segstat.functions import scalars as V
from segstat.operators import align as J, contracts as Q, splits as S
from segstat.sources import ingest as I, profiling as R


def cohort(spark, clusters=100, rows=3):
    return spark.range(clusters * rows).select(
        F.col("id").cast("string").alias("record_id"), F.expr(f"cast(id div {rows} as string)").alias("cluster_id"),
        F.expr(f"cast((id div {rows}) % 2 as int)").alias("target"))


@pytest.mark.parametrize("limit", [None, 3])
def test_folds_keep_clusters_together_and_cover_all(spark, monkeypatch, limit):
    if limit:
        from segstat.plans import ordering
        monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", limit)
    df = cohort(spark)
    rows = S.assign(df, S.group_folds(df, 5, 42)).collect()
    assert len(rows) == 300
    seen = {}
    for r in rows:
        seen.setdefault(r["cluster_id"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in seen.values())
    for fold in range(5):
        assert sum(1 for c, f in seen.items() if f == {fold}) == 20
    assert S.leakage(S.assign(df, S.group_folds(df, 5, 42)), "fold").count() == 0


def test_prior_clusters_stay_in_training(spark):
    df = cohort(spark, 100, 2)
    prior = spark.createDataFrame([(str(i),) for i in range(10)], "cluster_id string")
    split = S.split_with_prior(df, prior)
    assert {r["split"] for r in split.where("prior_seen").collect()} == {"train"}
    assert split.count() == 100 and split.select("cluster_id").distinct().count() == 100
    assert {r["split"] for r in split.collect()} == {"train", "val", "test"}
    with pytest.raises(S.TooFewClusters):
        S.split_with_prior(df, df.select("cluster_id"))


def test_nested_roles(spark):
    df = cohort(spark, 40)
    roles = S.nested_folds(df, 5, 4, 1)
    assert roles.groupBy("cluster_id").agg(F.count_if(F.col("role") == "hold").alias("h"), F.count("*").alias("n")).where("h <> 1 or n <> 5").count() == 0
    assert roles.groupBy("outer_fold").pivot("role", ["hold", "tune", "fit"]).count().where("hold <> 8 or tune < 8").count() == 0


def test_loso_plan_equals_explicit_exclusion(spark):
    df = spark.createDataFrame([("s1", "a", 0), ("s1", "b", 1), ("s2", "b", 0), ("s2", "c", 1), ("s3", "d", 0)], "site string, cluster_id string, target int")
    plan = {r["site"]: r for r in S.loso_plan(df, min_clusters=2).collect()}
    for site in ("s1", "s2", "s3"):
        held = df.where(F.col("site") == site)
        left = J.exclude_clusters(df, held)
        assert plan[site]["development_rows"] == left.count() and plan[site]["development_clusters"] == left.select("cluster_id").distinct().count()
    assert plan["s3"]["status"] == "insufficient_classes_or_groups"


def test_alignment_rejects_the_whole_record(spark):
    labels = Q.expand_bits(spark.createDataFrame([("a", "0_1_0_1_1"), ("b", "0_1"), ("c", "0_2")], "record_id string, bits string"), "bits", ["record_id"])
    assert [r["error"] for r in labels.where("record_id = 'c'").collect()] == ["not_binary_labels"]
    windows = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(2)], "record_id string, seg_idx int")
    checked = Q.check_alignment(labels.where("error is null"), windows)
    kept = Q.quarantine(windows, checked.where("not aligned"))
    assert {r["record_id"] for r in kept.collect()} == {"b"}


def test_sibling_tracks(spark):
    rows = [("42_2", True, f"toy_twin{t}_p{p}.png") for p in range(2) for t in (1, 2)] + [("7_0", False, "toy_p0.png")]
    got = Q.select_track(spark.createDataFrame(rows, "id string, paired boolean, name string"), "id", F.col("paired"), "name").collect()
    assert sorted(r["name"] for r in got) == ["toy_p0.png", "toy_twin2_p0.png", "toy_twin2_p1.png"]


def test_box_audit_reasons(spark):
    labels = spark.createDataFrame([(r, p, p) for r in "abcd" for p in (0, 1)], "record_id string, position long, bit int")
    boxes = spark.createDataFrame([("a", 100., 0., 200., 100., 200., 100.), ("b", 90., 0., 200., 100., 200., 100.), ("c", 0., 0., 100., 100., 200., 100.)],
                                  "record_id string, x1 double, y1 double, x2 double, y2 double, w double, h double")
    dims = spark.createDataFrame([(r, 200., 100.) for r in "abd"] + [("c", 200., 90.)], "record_id string, width double, height double")
    got = {r["record_id"]: (r["checked"], r["valid"], r["reason"]) for r in Q.box_audit(labels, boxes, dims).collect()}
    assert got == {"a": (True, True, "ok"), "b": (True, False, "segment_boundary"), "c": (True, False, "flag_positions,image_dimensions"), "d": (False, None, "positive_without_boxes")}
    missing = Q.box_audit(labels, boxes, dims.where("record_id <> 'a'")).where("record_id = 'a'").first()
    assert missing["reason"] == "image_missing" and not missing["checked"]


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("1", "h", None), ("1", "h", "box"), ("2", "h", "a"), ("2", "h", "b"), ("3", "x", None), ("3", "y", None), ("4", "z", "q")], "id string, content string, fill string")
    got = {r["id"]: (r["status"], r["fill"]) for r in R.dedup_with_conflicts(df, "id", "content", "fill").collect()}
    assert got["1"] == ("deduplicated", "box") and got["2"][0] == "conflict" and got["3"][0] == "conflict" and got["4"] == ("single", "q")
    groups = R.duplicate_groups(df, "id", ["content"]).collect()
    assert [(g["distinct_ids"], g["first_id"]) for g in groups] == [(2, "1")]
    assert R.duplicate_members(df, "id", ["content"]).count() == 2


def test_survey_tree(spark, tmp_path):
    for kind, name, text in (("annotation_person", "1", "{\"a\": 1}"), ("labels", "1", "{"), ("emr", "2", "[1]"), ("notes", "x", "{}")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(text)
    files = I.scan_sources(spark, str(tmp_path), ["annotation_person", "labels", "emr"])
    assert {r["kind"] for r in files.collect()} == {"annotation_person", "labels", "emr", "other:.json"}
    content = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(str(tmp_path))
    good, bad = I.read_json_tolerant(content, "value", "a int")
    assert {r["category"] for r in bad.collect()} == {"unreadable_json", "not_an_object"} and good.count() == 2


def test_empty_tables_keep_their_schema(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5)], "record_id string, score double")
    I.write_tables({"full": df, "empty": df.where("score > 9")}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "empty"))
    assert back.count() == 0 and back.schema == df.schema
    I.write_tables({"csv": df}, str(tmp_path / "c"), "csv")
    assert I.read_table(spark, str(tmp_path / "c" / "csv"), "record_id string, score double").first()["record_id"] == "007"
    recorded = I.manifest_of_files(spark, str(tmp_path / "full"))
    assert I.verify_manifest(recorded, recorded).count() == 0
    assert I.verify_manifest(recorded, recorded.limit(0)).first()["state"] == "missing"


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("1.5",), ("9999",), ("abc",), ("NaN",), ("inf",), (" ",), ("true",), (None,)], "t string")
    got = [(r[0], r[1]) for r in df.select(V.numeric_or_null(F.col("t")), V.number_error(F.col("t"))).collect()]
    assert [g[0] for g in got] == [1.5] + [None] * 7
    assert [g[1] for g in got] == [None, None, "not_numeric", "not_finite", "not_finite", "blank", "boolean", "blank"]


def test_cohort_difference_reports_every_kind(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 0)], "k int, target int")
    b = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "k int, target int")
    got = {r["k"]: r["problem"] for r in J.cohort_diff(a, b, ["k"], ["target"]).collect()}
    assert got == {2: "value_mismatch", 3: "duplicate_key", 4: "only_right"}


def test_increment_has_fifty_replicates_both_readings_and_a_gate(spark, monkeypatch):
    from segstat.operators import bootstrap, models
    from segstat.queries import model_queries
    few = spark.createDataFrame([(i, i, i % 2, float(i)) for i in range(10)], "record_id long, cluster_id long, target int, x double")
    [row] = model_queries.gated_increment(few, ["x"], ["x"], 3).collect()
    assert row["status"] == "insufficient_outcome_groups" and row["min_groups"] == 6 and row["positive_clusters"] == 5 and row["difference"] is None
    seen = {}
    real = models.incremental_value
    monkeypatch.setattr(models, "incremental_value", lambda rows, base, extra, k: seen.update(extra=extra, rows=rows) or real(rows, base, extra, k))
    found = model_queries.incremental_value(spark, "/root/testdata/sf0.001").collect()
    assert seen["extra"] == ["abnormal_fraction", "longest_abnormal_run"] and not seen["rows"].where("longest_abnormal_run > 1").isEmpty()
    assert {r["metric"] for r in found} == {"auroc", "auprc", "brier"} and {r["status"] for r in found} == {"ok"}
    assert all(10 < r["n_valid"] <= bootstrap.REPLICATES for r in found)


def test_pipeline_fills_with_the_exact_median(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from segstat.operators import models
    rows = [(1.0, 0), (2.0, 1), (10.0, 0), (20.0, 1), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame([(a, None if t else 5.0, t) for a, t in rows], "a double, b double, target int")
    assert models.exact_medians(df, ["a", "b"]) == {"a": 6.0, "b": 5.0}
    model = models.logistic(df, ["a", "b"])
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    score = lambda m: [round(r["score"], 9) for r in models.predict(m, df).collect()]
    assert score(model) == score(again)
    parts = {(r["a"], r["feature"]): r for r in models.linear_contributions(model, df.where("a IS NULL"), ["a", "b"], ["a"]).collect()}
    assert parts[(None, "a")]["value"] == 6.0


def test_transfer_roles_keep_the_held_site_apart(spark):
    from segstat.operators import models
    rows = [(c, s, (c + k) % 3 == 0, (c * 7 + k) % 11 / 11) for c in range(60) for k, s in enumerate([c % 4, (c // 9) % 4])]
    df = spark.createDataFrame([(f"c{c}", s, int(t), p) for c, s, t, p in rows], "cluster_id string, site int, target int, score double")
    roles = models.transfer_roles(df, F.col("site") == 3)
    found = {}
    for r in roles.collect():
        found.setdefault(r["role"], set()).add(r["cluster_id"])
    assert set(found) == {"fit", "validation", "held"} and not any(found[a] & found[b] for a, b in (("fit", "validation"), ("fit", "held"), ("validation", "held")))
    moved, slope = models.transfer(roles)
    limits = {r["arm"]: r["alarm_above"] for r in moved.select("arm", "alarm_above").distinct().collect()}
    assert set(limits) == {"raw", "platt"} and moved.count() == 2 * df.where("site = 3").count() and isinstance(slope, float)
