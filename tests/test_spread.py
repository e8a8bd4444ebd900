"""Large tables are dealt over as many tasks as their rows need, and the results stay the same."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import compare, connect
from segstat.operators import bootstrap as BS, replicates as R
from segstat.plans import ordering
from segstat.sources import bindings as B

SF = os.environ.get("SEGSTAT_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(BS, "DRAWS_PER_TASK", 1000)


def test_tasks_follow_the_rows(spark, small_tasks):
    lines = B.table(spark, SF, "lineitem").count()
    assert B.line_items(spark, SF, "l_orderkey").rdd.getNumPartitions() == -(-lines // 500)
    numbers = spark.range(2000).withColumnRenamed("id", "number").coalesce(1)
    assert BS._drawn(numbers, 10, 42).rdd.getNumPartitions() == 20
    assert ordering.spread_large(numbers, 2000, "number") is numbers


@pytest.mark.parametrize("name", ["E02_cardinality_violations", "G10_evaluate_by_site", "G11_cluster_weights", "G12_bootstrap_intervals", "G13_paired_difference", "G22_evaluate_subgroups"])
def test_dealt_queries_equal_sql(spark, small_tasks, name):
    problems = [p for p in compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) if p != "no rows"]
    assert not problems, problems


def test_weights_of_a_cluster_add_up_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(c, b, b + 1) for c in (None, 1, 2, 7) for b in (0, 2, 2, 4)] + [(9, 1, 300)]
        frame = spark.createDataFrame(rows, "cluster_id bigint, b int, weight bigint")
        got = {r["cluster_id"]: np.frombuffer(r["_w"], "<u4").tolist() for r in R.packed_weights(frame, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**{c: [1, 0, 6, 0, 5] for c in (None, 1, 2, 7)}, 9: [0, 300, 0, 0, 0]}


@pytest.mark.parametrize("name", ["G12_bootstrap_intervals", "G13_paired_difference"])
def test_rows_with_weights_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(R, "nearly_distinct", lambda reduced, rows, by: True)
    monkeypatch.setattr(R, "WEIGHTED_ROWS_PER_TASK", 500)
    problems = [p for p in compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) if p != "no rows"]
    assert not problems, problems


def test_rows_with_weights_equal_sums(spark, monkeypatch):
    """Where hardly two rows share a score no array of sums is made for each score, and nothing changes in the metrics."""
    rng = np.random.default_rng(3)
    rows = [(arm, int(c), float(round(rng.random(), 4)), int(p), int(1 - p), int(p * a), int((1 - p) * a))
            for arm in ("left", None) for c, p, a in zip(rng.integers(0, 90, 1500), rng.integers(0, 2, 1500), rng.integers(0, 2, 1500))]
    reduced = spark.createDataFrame(rows, "arm string, cluster_id long, score double, pos long, neg long, alarm_pos long, alarm_neg long")
    drawn = R.packed_weights(spark.createDataFrame([(int(c), b, int(rng.integers(1, 4))) for b in range(7) for c in rng.integers(0, 90, 60)], "cluster_id long, b int, weight int"), 7)
    found = lambda: {(r["arm"], r["b"]): r[2:] for r in R.replicate_metrics(reduced, None, drawn, 7, ["arm"], True).collect()}
    monkeypatch.setattr(R, "FEW_ROWS", 0)
    sums = found()
    monkeypatch.setattr(R, "FEW_ROWS", 8)
    monkeypatch.setattr(R, "WEIGHTED_ROWS_PER_TASK", 100)
    monkeypatch.setattr(R, "_ranges", None)
    assert R.nearly_distinct(reduced, 3000, ["arm"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = found()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == sums.keys() and len(got) == 14
    for k, values in got.items():
        assert list(values) == pytest.approx(list(sums[k]), abs=1e-12)
    hot = reduced.withColumn("score", F.lit(0.5))
    assert not R.nearly_distinct(hot, 3000, ["arm"])
