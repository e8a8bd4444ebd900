"""Selection, case review, disclosure control, journals and fitted models."""
import numpy as np
from pyspark.sql import functions as F

from segstat.operators import cases as K, disclosure as D, models as T, selection as L
from segstat.streaming import journal as N

SEEDS = (3, 11, 17)
WIDTHS = (4, 20, 32, 48, 72, 200)      # the fifth lies between the arms


def score_of(mode, width, seed):
    """Any fixed table of distinct values does."""
    return ((width * 37 + seed * 101 + len(mode) * 53) % 89) / 89


def grid(spark):
    rows = [(m, w, s, score_of(m, w, s)) for m in ("plain", "scaled") for w in WIDTHS for s in SEEDS]
    return spark.createDataFrame(rows, "normalization string, width int, seed int, validation_auprc double")


def chosen_width(mode, widths):
    return max(widths, key=lambda w: np.mean([score_of(mode, w, s) for s in SEEDS]))


def test_width_uses_the_mean_over_seeds(spark):
    chosen = {(r["normalization"], r["arm"]): (r["width"], r["seed"]) for r in L.select_capacity(grid(spark), SEEDS).collect()}
    want = {}
    for mode in ("plain", "scaled"):
        for arm, widths in (("small", [w for w in WIDTHS if w <= 32]), ("medium", [w for w in WIDTHS if w >= 64])):
            width = chosen_width(mode, widths)
            want[mode, arm] = width, max(SEEDS, key=lambda s: score_of(mode, width, s))
    assert chosen == want
    plan = L.matched_plan(grid(spark).where("not (normalization = 'scaled' and seed = 11)"), SEEDS, "plain", "scaled").collect()
    assert {(r["arm"], r["width"], r["seed"]): r["status"] for r in plan} == {
        (arm, want["plain", arm][0], s): "missing_pair" if s == 11 else "ok" for arm in ("small", "medium") for s in SEEDS}


def test_incomplete_or_repeated_seeds_are_rejected(spark):
    g = grid(spark)
    bad = lambda df: {(r["normalization"], r["width"]) for r in L.rejected_grids(df, SEEDS).collect()}
    assert bad(g) == set()
    assert bad(g.where("not (width = 48 and seed = 17)")) == {("plain", 48), ("scaled", 48)}
    assert bad(g.union(g.where("width = 4 and seed = 3 and normalization = 'plain'"))) == {("plain", 4)}
    assert bad(g.union(g.where("width = 20").withColumn("seed", F.lit(5)))) == {("plain", 20), ("scaled", 20)}


def test_extreme_cases_are_deterministic(spark):
    rng = np.random.default_rng(31)
    rows = [(f"q{i:03d}", i % 3, int(rng.integers(0, 2)), float(rng.integers(0, 12)) / 12, .5) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id string, seg_idx int, target int, score double, threshold double")
    want = []
    for name, target, alarm in (("TP", 1, True), ("FP", 0, True), ("FN", 1, False), ("TN", 0, False)):
        inside = sorted((r for r in rows if r[2] == target and (r[3] >= .5) == alarm), key=lambda r: (-r[3] if alarm else r[3], r[0], r[1]))
        want += [(name, k, r[0]) for k, r in enumerate(inside[:2], 1)]
    got = K.extreme_cases(df).collect()
    assert sorted((r["category"], r["case_number"], r["record_id"]) for r in got) == sorted(want)
    first, second, third = (w[2] for w in want[:3])
    source = df.select("record_id", "seg_idx", F.when(F.col("record_id") == first, 1 - F.col("target")).otherwise(F.col("target")).alias("target")).where(F.col("record_id") != second)
    status = {r["record_id"]: r["alignment"] for r in K.case_signals(K.extreme_cases(df), source).collect()}
    assert status[first] == "target_mismatch" and status[second] == "missing" and status[third] == "ok"


def test_suppression_of_boxes(spark):
    rows = [("a", 0, 20., 20., 10., 10., .9, .8), ("a", 1, 20., 20., 10., 10., .8, .8), ("a", 2, 90., 20., 10., 10., .9, .9), ("b", 0, 5., 5., 2., 2., .01, .01)]
    df = spark.createDataFrame(rows, "record_id string, box_no long, cx double, cy double, w double, h double, obj double, cls double")
    assert np.allclose(sorted(r["score"] for r in K.nms(df).collect()), [.72, .81])
    assert K.nms(df, max_det=1).count() == 1


def test_right_edge_belongs_to_the_last_segment(spark):
    boxes = spark.createDataFrame([("a", 95., 105., .8), ("a", 0., 20., .2)], "record_id string, x1 double, x2 double, confidence double")
    dims = spark.createDataFrame([("a", 100, 2)], "record_id string, width int, n_segments long")
    assert [r["score"] for r in K.box_segment_score(boxes, dims).orderBy("seg_idx").collect()] == [.2, .8]


def test_stop_reasons_and_recent_gain(spark):
    jobs = spark.createDataFrame([("cap", 60, 59, 60, 8, True), ("patient", 31, 20, 60, 8, True), ("odd", 31, 27, 60, 8, True), ("lost", None, None, 60, 8, True), ("live", 7, 7, 60, 8, False)],
                                 "job string, iterations_run long, best_iteration long, cap long, patience long, complete boolean")
    got = {r["job"]: (r["stop_reason"], r["patience_met"]) for r in L.stop_diagnosis(jobs).collect()}
    assert got == {"cap": ("budget_cap", False), "patient": ("early_stopping", True), "odd": ("unknown_stop", False), "lost": ("uncollected", None), "live": ("incomplete_or_running", False)}
    history = spark.createDataFrame([(1, i, i / 100) for i in range(1, 31)] + [(2, 1, .5)], "job int, iteration long, score double")
    gains = {r["job"]: (r["recent_window"], r["recent_best_gain"]) for r in L.recent_gain(history).collect()}
    assert gains[1][0] == 20 and np.isclose(gains[1][1], .2) and gains[2] == (1, None)


def test_small_and_unknown_denominators_fail_closed(spark):
    rows = [("ok", .8, 40, 20, 20), ("small", .8, 12, 1, 11), ("unknown", .9, None, None, None)]
    df = spark.createDataFrame(rows, "model string, auroc double, clusters long, positive_clusters long, negative_clusters long")
    got = {r["model"]: r for r in D.screen(df, ["auroc", "clusters"]).collect()}
    assert got["ok"]["auroc"] == .8 and got["ok"]["review_status"] == D.SCREENED
    for model in ("small", "unknown"):
        assert got[model]["auroc"] is None and got[model]["clusters"] is None and got[model]["review_status"] == D.SUPPRESSED


def test_one_small_bin_blocks_its_feature_and_partition(spark):
    df = spark.createDataFrame([("stv", 0, 40, 20, 20), ("stv", 1, 3, 1, 2), ("sd", 0, 40, 20, 20)], "feature string, bin int, clusters long, positive_clusters long, negative_clusters long")
    got = D.screen_complementary(df, ["feature"], ["clusters"]).collect()
    assert {r["feature"] for r in got if r["clusters"] is None} == {"stv"} and len(got) == 3
    cells = spark.createDataFrame([("p", 0), ("p", 12), ("q", 4), ("q", 30)], "k string, clusters long")
    assert {r["k"] for r in D.screen_partition(cells, ["k"], ["clusters"], "clusters").where("clusters is not null").collect()} == {"p"}


def test_alarm_metrics_need_their_own_clusters(spark):
    df = spark.createDataFrame([(.7, .1, 40, 20, 20, 20, 5, 15)], "auroc double, normal_record_alarm_rate double, clusters long, positive_clusters long, negative_clusters long, normal_clusters long, normal_alarm_clusters long, normal_quiet_clusters long")
    row = D.screen_alarm_metrics(df, ["auroc", "normal_record_alarm_rate"], ["normal_record_alarm_rate"]).first()
    assert row["auroc"] == .7 and row["normal_record_alarm_rate"] is None


def test_pseudonyms_hide_names(spark):
    rows = D.pseudonymise(spark.createDataFrame([("secret-b", 1), ("secret-a", 2)], "site string, n int"), "site").collect()
    assert sorted((r["alias"], r["n"]) for r in rows) == [("S01", 2), ("S02", 1)] and "site" not in rows[0].asDict()
    assert D.banned_columns(spark.createDataFrame([(1, 2)], "record_id int, n int")) == ["record_id"]


def test_feature_response_merges_repeated_edges(spark):
    values = [0.0] * 50 + [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("f", v, i, i % 2) for i, v in enumerate(values)], "feature string, value double, cluster_id int, target int")
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 9)))
    labels = np.searchsorted(edges[1:-1], values, side="left")
    got = {r["bin"]: r["n_segments"] for r in K.feature_response(df).collect()}
    assert got == {int(b): int((labels == b).sum()) for b in np.unique(labels)}


def test_spline_basis_sums_to_one_with_its_bias_term(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-4, 4, 33)], "x double")
    full = T.spline_terms("x", -3, 3)
    total = [r[0] for r in df.select(sum(full, F.lit(0.0)).alias("s")).collect()]
    assert len(full) == 6 and all(-1e-9 <= t <= 1 + 1e-9 for t in total)
    assert T.spline_terms("x", 2, 2)[0] is not None and len(T.spline_terms("x", 2, 2)) == 1


def test_spline_separates_u_shaped_risk_where_a_line_cannot(spark):
    rng = np.random.default_rng(0)
    data = [(float(x), int(abs(x) > 1.5)) for x in rng.uniform(-3, 3, 400)]
    df = spark.createDataFrame(data, "x double, target int")
    linear = T.single_feature_scan(df, df, ["x"]).first()["validation_auroc"]
    curved = T.single_feature_scan(df, df, ["x"], "nonlinear_spline").first()["validation_auroc"]
    assert linear < .6 and curved > .98


def test_blocked_stages_and_durations(spark):
    stages = spark.createDataFrame([(1, "data", "complete"), (1, "splits", "failed"), (1, "fit", "complete")], "run int, stage string, status string")
    edges = spark.createDataFrame([("splits", "data"), ("fit", "splits"), ("report", "fit")], "stage string, needs string")
    got = {r["stage"]: r["blocked"] for r in N.blocked_stages(stages, edges).collect()}
    assert got == {"data": False, "splits": False, "fit": True, "report": True}


def test_rates_from_a_stream_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = [(int(s), k, float(k // 2), float(rng.integers(0, 1000))) for s in (1, 2) for k in range(300)]
    rng.shuffle(data)
    rows = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in data], "source long, sample long, seconds double, counter double")
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    rows.limit(350).repartition(5).write.parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    assert N.counter_rate_stream(stream(), root).count() == 350
    rows.exceptAll(spark.read.parquet(folder)).repartition(4).write.mode("append").parquet(folder)
    key = lambda df: sorted((r["source"], r["sample"], r["rate"] is None, r["rate"] or 0.0) for r in df.select("source", "sample", "rate").collect())
    want = key(N.counter_rate(rows, "source", ["seconds", "sample"], "counter", "seconds"))
    assert key(N.counter_rate_stream(stream(), root)) == want
    assert key(N.counter_rate_stream(stream(), root)) == want      # nothing new


def test_complete_output_continues_in_its_folder(spark, tmp_path):
    rows = spark.range(20).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event", "'s' AS stage")
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    count = lambda: {r["event"]: r["count"] for r in N.run_available(N.event_counts(
        spark.readStream.schema(rows.schema).parquet(folder), ["a", "b"]), "counts", "complete", root=root).collect()}
    rows.write.parquet(folder)
    assert count() == {"a": 10, "b": 10}
    assert count() == {"a": 10, "b": 10}
    rows.write.mode("append").parquet(folder)
    assert count() == {"a": 20, "b": 20}


def test_linked_tables_leave_no_cell_to_subtract(spark):
    """Random cohorts of two break-downs: no blanked number is fixed by what is shown and by the sums."""
    rng = np.random.default_rng(4)
    outcomes = set()
    for trial in range(8):
        a = rng.integers(0, 30, rng.integers(1, 5)) if trial else np.array([12, 14])
        total = int(a.sum())
        cut = np.sort(rng.integers(0, total + 1, rng.integers(0, 3)))
        b = np.diff(np.concatenate([[0], cut, [total]]))
        frame = lambda counts, key: spark.createDataFrame([(f"{key}{i}", int(n), int(n) * 3) for i, n in enumerate(counts)], f"{key} string, clusters long, records long")
        margin = spark.createDataFrame([("all", total, total * 3)], "item string, clusters long, records long")
        tables, top = D.screen_linked({"a": (frame(a, "a"), "a"), "b": (frame(b, "b"), "b")}, margin, ["clusters", "records"],
                                      D.empty_or_enough("clusters", 10), "clusters", 10)
        shown = [[r["records"] for r in tables[k].orderBy(k).collect()] for k in "ab"] + [[top.first()["records"]]]
        assert [len(v) for v in shown] == [len(a), len(b), 1]
        for values, counts in zip(shown, (a, b)):
            assert all(v is None or v == 3 * n for v, n in zip(values, counts))
            assert all(v is None for v, n in zip(values, counts) if 0 < n < 10)
        # Unknowns that the two sums determine lie in no direction of the null space.
        cells = [v for part in shown for v in part]
        unknown = [i for i, v in enumerate(cells) if v is None]
        system = np.zeros((2, len(cells)))
        system[0, :len(a)], system[1, len(a):-1], system[:, -1] = 1, 1, -1
        left = system[:, unknown]
        free = np.linalg.svd(left)[2][np.linalg.matrix_rank(left):] if unknown else np.zeros((0, 0))
        assert all(np.abs(free[:, j]).max(initial=0) > 1e-9 for j in range(len(unknown))), (a, b, shown)
        outcomes.add((bool(unknown), shown[2][0] is None))
    assert len(outcomes) >= 2


def test_linked_tables_hide_the_smallest_cell_or_the_total(spark):
    cells = lambda key, *counts: spark.createDataFrame([(f"{key}{i}", n) for i, n in enumerate(counts)], f"{key} string, clusters long")
    screen = lambda a, b, t: D.screen_linked({"a": (cells("a", *a), "a"), "b": (cells("b", *b), "b")}, cells("item", t), ["clusters"], D.empty_or_enough("clusters", 10), "clusters", 10)
    read = lambda df: [r["clusters"] for r in df.orderBy(df.columns[0]).collect()]
    tables, total = screen((4, 20, 16, 30), (35, 35), 70)
    assert read(tables["a"]) == [None, 20, None, 30] and read(tables["b"]) == [35, 35] and read(total) == [70]
    tables, total = screen((4, 3), (7, 0), 7)
    assert read(tables["a"]) == [None, None] and read(tables["b"]) == [None, 0] and read(total) == [None]
    tables, total = screen((40, 40), (80,), 80)
    assert read(tables["a"]) == [40, 40] and read(total) == [80]
