"""Results that must not hang on the order in which rows arrive or on the last bit of a sum."""
import datetime
import math

import duckdb

import __spark_entry__ as entry
from check_queries import compare
from segstat.operators import features as X, segment_row as R
from segstat.queries.signal_queries import eight_decimals

WHOLE = [144.31, 4.89, 4.07, 86.63, 150.26, 60.99, 34.66, 67.54, 4.65]       # the mean is 62, a running sum gives 61.99999999999999


def test_whole_means_and_medians_are_not_cut_below(spark):
    rows = [(r, i, x, x) for r, v in ((0, WHOLE), (1, [0.01, 17.99])) for i, x in enumerate(v)]
    out = {r["record_id"]: r for r in X.record_stats(spark.createDataFrame(rows, "record_id bigint, i bigint, x double, y double"), ["x", "y"]).collect()}
    assert out[0]["mean_x"] == 62 and out[1]["median_x"] == 9 and out[1]["mean_y"] == 9


def test_record_means_are_added_in_sample_order_as_the_sql_adds_them(spark, tmp_path):
    """Readings whose mean is 62, added one by one, end below it: SQL cuts that to 61, and so must the query. Record 1 has a
    reading, record 2 a median within nine decimals of a whole number, record 3 has a null."""
    day = datetime.datetime(2024, 1, 1)
    readings = {0: WHOLE, 1: [5.9999999999], 2: [0.0, 11.9999999999], 3: [1.5, None, 2.5], 4: [0.01, 17.99], 5: WHOLE[::-1]}
    rows = [(u, v, day + datetime.timedelta(seconds=i)) for u, vs in readings.items() for i, v in enumerate(vs)]
    events = [(n, ts, u, "view", v, '{"k": %d}' % n) for n, (u, v, ts) in enumerate(rows)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    out = entry.queries()["D13_record_stats"](spark, str(tmp_path))
    assert not (problems := compare(out, con, entry.oracle_sql()["D13_record_stats"])), problems
    got = {r["record_id"]: r for r in out.collect()}
    assert got[0]["mean_x"] == 61 and got[1]["mean_x"] == 5 and got[2]["median_x"] == 5 and got[4]["median_x"] == 9


def test_ordered_record_means_do_not_hang_on_arrival(spark):
    rows = [(0, i, x) for i, x in enumerate(WHOLE)]
    for part in (rows, rows[::-1], rows[4:] + rows[:4]):
        df = spark.createDataFrame(part, "record_id bigint, i bigint, x double").coalesce(1)
        assert X.record_stats(df, ["x"], order=["i"]).first()["mean_x"] == 61


def test_correlation_of_a_channel_constant_but_for_the_last_bit(spark):
    x, y = [1.65, 1.6499999999999997, 1.65], [34.0, 40.0, 47.0]
    rows = [(0, 0, i, a, b) for i, (a, b) in enumerate(zip(x, y))]
    schema = "record_id bigint, seg_idx bigint, sample_idx bigint, x double, y double"
    got = [X.features28(spark.createDataFrame(part, schema).coalesce(1), 0.1, 20, 100).first()["ft_corr0"] for part in (rows, rows[::-1])]
    assert got[0] == got[1] and round(got[0], 7) == -0.6520712


def test_moments_in_the_row_equal_plain_ones(spark):
    x, y = [3.0, 8.5, 1.0, 4.25], [2.0, 7.0, 7.0, 1.0]
    r = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(R.paired_moments().alias("m")).first()["m"]
    mx, my = sum(x) / 4, sum(y) / 4
    sx, sy = (math.sqrt(sum((v - m) ** 2 for v in c) / 4) for c, m in ((x, mx), (y, my)))
    want = (mx, my, sx, sy, sum((a - mx) * (b - my) for a, b in zip(x, y)) / 4 / sx / sy)
    assert all(abs(a - b) < 1e-12 for a, b in zip((r["mx"], r["my"], r["sx"], r["sy"], r["r"]), want))


def test_halves_at_the_ninth_decimal_go_up(spark):
    half = 53.56555555499999            # scaled by 1e8 this is 5356555555.5 less than half a unit in the last place
    out = eight_decimals(spark.createDataFrame([(53.565555555,), (half,), (-53.565555555,)], "v double"), "v")
    assert [r["v"] for r in out.collect()] == [math.floor(v * 1e8 + 0.5) / 1e8 if v > 0 else -math.floor(-v * 1e8 + 0.5) / 1e8 for v in (53.565555555, half, -53.565555555)]
