"""The range-splitting plans give exactly the plain results, with one key holding a third of the rows."""
import random

import numpy as np
from pyspark.sql import functions as F

from segstat.functions.scalars import keyed_md5
from segstat.plans import ordering as O


def skewed(spark, rows=300):
    random.seed(5)
    data = [("hot" if n % 3 == 0 else f"k{n % 40}", random.choice([1, 1, 1, 2, 5, 9]), random.randint(0, 4), n) for n in range(rows)]
    return spark.createDataFrame(data, "k string, a long, b long, id long"), data


def test_ordered_index_equals_row_number(spark, small_limit):
    df, data = skewed(spark)
    got = {r["id"]: r["i"] for r in O.ordered_index(df, ["k"], ["a", "b", "id"]).collect()}
    expected = {}
    for key in {d[0] for d in data}:
        for i, d in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1:])):
            expected[d[3]] = i
    assert got == expected


def test_running_totals_equal_cumulative_sums(spark, small_limit):
    df, data = skewed(spark)
    points = df.groupBy("k", "a").agg(F.sum("b").alias("v")).withColumn("u", F.col("a") / 10)
    for order in ("a", "u"):
        for descending in (False, True):
            rows = O.running_totals(points, ["k"], order, ["v"], descending=descending, limit=1).collect()
            for key in {r["k"] for r in rows}:
                mine = sorted((r for r in rows if r["k"] == key), key=lambda r: r[order], reverse=descending)
                assert [r["cum_v"] for r in mine] == list(np.cumsum([r["v"] for r in mine]))
                assert {r["total_v"] for r in mine} == {sum(r["v"] for r in mine)}


def test_ordered_means_of_hot_and_null_groups(spark, small_limit):
    random.seed(8)
    data = [(None if n % 5 == 0 else n % 5 if n % 50 < 10 else 9, n, None if n % 11 == 0 else random.random(), None) for n in range(200)] + [(77, 0, .1, 3.), (77, 2, .3, None), (77, 1, .2, 4.)]
    df = spark.createDataFrame(data, "k long, i long, a double, b double")
    got = {r["k"]: (r["mean_a"], r["mean_b"]) for r in O.ordered_means(df, ["k"], ["i"], ["a", "b"]).collect()}
    assert set(got) == {d[0] for d in data} and got[77] == ((.1 + .2 + .3) / 3, 3.5)
    for key, (a, b) in got.items():
        assert abs(a - np.mean([d[2] for d in data if d[0] == key and d[2] is not None])) < 1e-12 and (key == 77 or b is None)


def test_digest_index_equals_sorted_position(spark, small_limit):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2).alias("s")).withColumn("h", keyed_md5(7, F.col("id")))
    rows = O.digest_index(df, ["s"], "h").collect()
    for s in (0, 1):
        ordered = sorted((r for r in rows if r["s"] == s), key=lambda r: r["h"])
        assert [r["i"] for r in ordered] == list(range(100))


def test_previous_row_on_hot_group(spark, small_limit):
    df, data = skewed(spark)
    rows = O.previous_row(df, ["k"], ["a", "b", "id"], ["id"]).collect()
    got = {r["id"]: r["prev_id"] for r in rows}
    for key in {d[0] for d in data}:
        ids = [d[3] for d in sorted((d for d in data if d[0] == key), key=lambda d: d[1:])]
        assert [got[i] for i in ids] == [None, *ids[:-1]]


def test_exact_quantiles_match_numpy(spark, small_limit):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 40, 301)]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    row = O.exact_quantiles(df, ["k"], "v", [0.025, 0.5, 0.9], ["a", "b", "c"]).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.quantile(values, [0.025, 0.5, 0.9]))


ODD = [float("nan"), None, 0.0, -0.0, 1.0, 1.0, float("inf"), -2.5]


def odd_rows(spark):
    random.seed(9)
    rows = [(random.choice(["hot", "hot", None, "k"]), random.choice(ODD), random.choice([None, "", "a", "aaaaaaaaaa", "aaaaaaaaab", "é"]), n) for n in range(240)]
    return spark.createDataFrame(rows, "k string, x double, s string, id long")


def by_id(df):
    return {r["id"]: tuple(str(v) for v in r) for r in df.collect()}


def test_both_plans_agree_on_odd_values(spark):
    df = odd_rows(spark)
    for order in (["x", "id"], ["s", "id"], ["s", "x", "id"]):
        few, many = (O.ordered_index(df, ["k"], order, "i", limit) for limit in (10, 10_000))
        assert by_id(few.select("id", "i")) == by_id(many.select("id", "i"))
        few, many = (O.previous_row(df, ["k"], order, ["id", "x"], "p_", limit) for limit in (10, 10_000))
        assert by_id(few.select("id", "p_id", "p_x")) == by_id(many.select("id", "p_id", "p_x"))


def test_running_totals_agree_on_odd_values(spark):
    df = odd_rows(spark)
    for order in ("x", "s"):
        points = df.groupBy("k", order).agg(F.sum("id").alias("v"))
        for descending in (False, True):
            few, many = (O.running_totals(points, ["k"], order, ["v"], descending=descending, limit=limit) for limit in (1, 10_000))
            assert sorted(map(str, few.select(sorted(few.columns)).collect())) == sorted(map(str, many.select(sorted(many.columns)).collect()))
