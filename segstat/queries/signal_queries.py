"""Windowed-signal operators (C) and segment features (D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X, signal as C, splits as S
from ..sources import bindings as B
from ..sources.scratch import materialize
from .metric_queries import rounded
from .registry import query

FS = B.SAMPLE_RATE
SEG = ["record_id", "seg_idx"]
P = "PARTITION BY record_id, seg_idx ORDER BY sample_idx"


def signal(spark, d):
    return B.samples(spark, d).select(*SEG, "sample_idx", "x", "y")


def runs_sql(source: str, pred: str, min_len: int = 1) -> str:
    return f"""(SELECT record_id, seg_idx, min(sample_idx) AS start, max(sample_idx) + 1 AS "end", count(*) AS length
 FROM (SELECT *, sample_idx - row_number() OVER ({P}) AS g FROM {source} WHERE {pred}) GROUP BY record_id, seg_idx, g HAVING count(*) >= {min_len})"""


@query("C01_zero_runs", f"SELECT * FROM {runs_sql('samples', 'x = 0', 2)}")
def zero_runs(spark, d):
    return C.runs(signal(spark, d), F.col("x") == 0, 2)


@query("C02_longest_zero_run", f"""WITH g AS (SELECT record_id, seg_idx, x, sum(CASE WHEN x = 0 THEN 0 ELSE 1 END) OVER ({P}) AS k FROM samples),
r AS (SELECT record_id, seg_idx, k, count(*) FILTER (WHERE x = 0) AS len FROM g GROUP BY ALL)
SELECT record_id, seg_idx, max(len) AS longest_zero FROM r GROUP BY ALL""")
def longest_zero(spark, d):
    return C.longest_run(signal(spark, d), F.col("x") == 0, "longest_zero")


@query("C02_longest_flat_run", f"""WITH s AS (SELECT record_id, seg_idx, sample_idx, floor(y / 20) AS v FROM samples),
a AS (SELECT *, CASE WHEN v <> 0 AND v = lag(v) OVER ({P}) THEN 0 ELSE 1 END AS brk FROM s),
g AS (SELECT *, sum(brk) OVER ({P}) AS k FROM a),
r AS (SELECT record_id, seg_idx, k, count(*) FILTER (WHERE v <> 0) AS len FROM g GROUP BY ALL)
SELECT record_id, seg_idx, max(len) AS longest_flat FROM r GROUP BY ALL""")
def longest_flat(spark, d):
    coarse = signal(spark, d).withColumn("v", F.floor(F.col("y") / 20).cast("double"))
    return C.longest_flat(coarse, "v")


def impute_sql(source: str, column: str, max_gap: int | None, name: str, valid: str = "<> 0") -> str:
    """CTEs that fill gaps of one column of a source, keeping its other columns."""
    w = "PARTITION BY record_id, seg_idx ORDER BY sample_idx"
    fits = "true" if max_gap is None else f"stop - start <= {max_gap}"
    return f"""{name}_n AS (SELECT *, last_value(CASE WHEN {column} {valid} THEN sample_idx END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
  last_value(CASE WHEN {column} {valid} THEN {column} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
  first_value(CASE WHEN {column} {valid} THEN sample_idx END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri,
  first_value(CASE WHEN {column} {valid} THEN {column} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv,
  max(sample_idx) OVER (PARTITION BY record_id, seg_idx) AS lastpos FROM {source}),
{name}_g AS (SELECT *, coalesce(li + 1, 0) AS start, coalesce(ri, lastpos + 1) AS stop FROM {name}_n),
{name} AS (SELECT * EXCLUDE (li, lv, ri, rv, lastpos, start, stop) REPLACE (CASE WHEN {column} {valid} OR NOT ({fits}) THEN {column}
   ELSE coalesce(CASE WHEN li IS NULL THEN rv WHEN ri IS NULL THEN lv ELSE lv + (rv - lv) * ((sample_idx - li) / (stop - start + 1)::DOUBLE) END, {column}) END AS {column}) FROM {name}_g)"""


def smooth_sql(source: str, columns: tuple, window: int, name: str) -> str:
    f = f"(PARTITION BY record_id, seg_idx ORDER BY sample_idx ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING)"
    cols = ", ".join(f"CASE WHEN {c} <> 0 THEN avg(nullif({c}, 0)) OVER {f} ELSE CAST(0 AS DOUBLE) END AS {c}" for c in columns)
    return f"{name} AS (SELECT * REPLACE ({cols}) FROM {source})"


BASE = "s AS (SELECT record_id, seg_idx, sample_idx, x, y FROM samples)"
ROUNDED_XY = "SELECT record_id, seg_idx, sample_idx, round(x, 6) AS x, round(y, 6) AS y FROM"


@query("C03_impute_gaps", f"WITH {BASE}, {impute_sql('s', 'x', 2, 'f')} {ROUNDED_XY} f")
def impute_gaps(spark, d):
    return rounded(C.impute_gaps(signal(spark, d), ["x"], 2), "x", "y")


@query("C04_smooth", f"WITH {BASE}, {smooth_sql('s', ('x', 'y'), 4, 'm')} {ROUNDED_XY} m")
def smooth(spark, d):
    return rounded(C.smooth(signal(spark, d), ["x", "y"], 4), "x", "y")


@query("C04_smooth_weighted", f"""WITH {BASE}, k AS (SELECT *, lag(nullif(x, 0)) OVER w AS a, lead(nullif(x, 0)) OVER w AS b FROM s WINDOW w AS ({P}))
SELECT record_id, seg_idx, sample_idx, round(CASE WHEN x = 0 THEN 0.0 ELSE (coalesce(a * 0.5, 0) + x * 1.0 + coalesce(b * 0.25, 0)) /
 (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + 1.0 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END)::DOUBLE END::DOUBLE, 6) AS x, round(y, 6) AS y FROM k""")
def smooth_weighted(spark, d):
    return rounded(C.smooth(signal(spark, d), ["x"], 3, [0.25, 1.0, 0.5]), "x", "y")


CLEAN = ", ".join([BASE, impute_sql("s", "x", 1, "fx"), impute_sql("fx", "y", 1, "fy"), smooth_sql("fy", ("x", "y"), 3, "sm"),
                   impute_sql("sm", "x", None, "gx"), impute_sql("gx", "y", None, "clean")])
# Both channels at 9 decimals, so bin edges and plateaus are the same in every engine.
EXACT = """clean AS (SELECT * REPLACE (round(x, 9) AS x, round(y, 9) AS y) FROM raw)"""


def exact_clean_sql(base: str) -> str:
    return ", ".join([base, impute_sql("s", "x", 1, "fx"), impute_sql("fx", "y", 1, "fy"), smooth_sql("fy", ("x", "y"), 3, "sm"),
                      impute_sql("sm", "x", None, "gx"), impute_sql("gx", "y", None, "raw"), EXACT])


CLEAN_0 = ", ".join([impute_sql("fy", "x", None, "hx"), impute_sql("hx", "y", None, "clean0")])


def clean(spark, d, smooth_seconds=30):
    return C.preprocess(signal(spark, d), ("x", "y"), FS, smooth_seconds)


@query("C05_preprocess", f"WITH {CLEAN} {ROUNDED_XY} clean")
def preprocess(spark, d):
    return rounded(clean(spark, d), "x", "y")


@query("C05_preprocess_unsmoothed", f"WITH {CLEAN}, {CLEAN_0} {ROUNDED_XY} clean0")
def preprocess_unsmoothed(spark, d):
    return rounded(clean(spark, d, 0), "x", "y")


@query("C06_interpolate_primary", f"WITH {BASE}, {impute_sql('s', 'x', None, 'f', '> 0')} {ROUNDED_XY} f")
def interp_primary(spark, d):
    return rounded(C.interp_primary(signal(spark, d)), "x", "y")


BASELINE = """arr AS (SELECT record_id, seg_idx, list(x ORDER BY sample_idx) AS xs FROM clean GROUP BY ALL),
open AS (SELECT *, list_aggregate(list_filter(xs, lambda v: v > 0)[1:60], 'avg') AS b0 FROM arr),
it AS (SELECT record_id, seg_idx, xs, b0 AS b, b0 AS mask, false AS done, 0 AS step FROM open WHERE b0 IS NOT NULL
       UNION ALL
       SELECT record_id, seg_idx, xs, nb, b, abs(nb - b) < 0.5, step + 1
       FROM (SELECT *, coalesce(list_aggregate(list_filter(xs, lambda v: abs(v - b) < 15 AND v <> 0), 'avg'), b) AS nb FROM it WHERE NOT done AND step < 50)),
base AS (SELECT o.record_id, o.seg_idx, arg_max(b, step) AS baseline, arg_max(mask, step) AS mask_base FROM open o LEFT JOIN it USING (record_id, seg_idx) GROUP BY ALL)"""


def base_and_dev(spark, d):
    return C.deviations(clean(spark, d), "x", FS)


@query("C07_baseline", f"WITH RECURSIVE {CLEAN}, {BASELINE} SELECT record_id, seg_idx, round(baseline, 8) AS baseline, round(mask_base, 8) AS mask_base FROM base")
def baseline(spark, d):
    return rounded(C.baseline(clean(spark, d), "x", FS), "baseline", "mask_base", digits=8)


DEV = BASELINE + """,
dev AS (SELECT c.*, baseline, x - baseline AS dev, coalesce(abs(x - mask_base) < 15 AND x <> 0, false) AS keep FROM clean c JOIN base USING (record_id, seg_idx))"""
VARIABILITY = f"""kr AS (SELECT *, sample_idx - row_number() OVER ({P}) AS g FROM dev WHERE keep),
ks AS (SELECT *, count(*) OVER (PARTITION BY record_id, seg_idx, g) AS size, lag(x) OVER (PARTITION BY record_id, seg_idx, g ORDER BY sample_idx) AS px FROM kr),
kt AS (SELECT *, CASE WHEN x <> px THEN sign(x - px) END AS sg FROM ks WHERE size >= 3),
ku AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY record_id, seg_idx, g ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS psg FROM kt),
kv AS (SELECT *, abs(px - lag(px) OVER (PARTITION BY record_id, seg_idx, g ORDER BY sample_idx)) AS gap FROM ku WHERE sg <> psg),
var AS (SELECT record_id, seg_idx, avg(gap) AS v FROM kv GROUP BY ALL)"""


@query("C08_baseline_variability", f"""WITH RECURSIVE {CLEAN}, {DEV}, {VARIABILITY}
SELECT record_id, seg_idx, round(coalesce(v, 0), 6) AS baseline_variability FROM (SELECT DISTINCT record_id, seg_idx FROM dev) LEFT JOIN var USING (record_id, seg_idx)""")
def baseline_variability(spark, d):
    return rounded(C.baseline_variability(base_and_dev(spark, d)), "baseline_variability")


def events_sql(pred: str, name: str, min_len: int = 2) -> str:
    return f"""{name} AS (SELECT record_id, seg_idx, min(sample_idx) AS start, max(sample_idx) + 1 AS "end", count(*) AS length,
  (list(sample_idx ORDER BY x, sample_idx))[1] AS nadir, (list(sample_idx ORDER BY x DESC, sample_idx))[1] AS peak, min(x) AS low, max(x) AS high, first(baseline) AS baseline
  FROM (SELECT *, sample_idx - row_number() OVER ({P}) AS g FROM dev WHERE {pred}) GROUP BY record_id, seg_idx, g HAVING count(*) >= {min_len})"""


@query("C09_accelerations", f"""WITH RECURSIVE {CLEAN}, {DEV}, {events_sql('dev >= 15 AND x > 0', 'e')}
SELECT record_id, seg_idx, start, "end", peak, round(high, 6) AS high FROM e WHERE length < 60 AND peak - start < 3""")
def accelerations(spark, d):
    return rounded(C.accelerations(base_and_dev(spark, d), "x", FS), "high")


DOWN = events_sql("dev <= -15 AND x > 0", "down")


@query("C10_decelerations", f"""WITH RECURSIVE {CLEAN}, {DEV}, {DOWN}
SELECT record_id, seg_idx, start, "end", nadir, round(baseline - low, 6) AS depth FROM down""")
def decelerations(spark, d):
    return rounded(C.decelerations(base_and_dev(spark, d), "x", FS), "depth")


# Peaks are compared on values rounded to 9 decimals, so plateaus are the same in every engine.
CONTRACTIONS = """cv AS (SELECT record_id, seg_idx, sample_idx, round(y, 9) AS y FROM clean),
carr AS (SELECT record_id, seg_idx, list(y ORDER BY sample_idx) AS v, stddev_pop(y) AS sd, CAST(count(*) AS BIGINT) AS n FROM cv GROUP BY ALL HAVING min(y) < max(y) AND count(*) >= 3),
cpk AS (SELECT *, unnest(range(2, n)) AS i FROM carr),
cpl AS (SELECT *, list_filter(range(i + 1, n + 1), lambda j: v[j] <> v[i])[1] AS b FROM cpk WHERE v[i - 1] < v[i]),
cst AS (SELECT record_id, seg_idx, list((i + b - 3) // 2 ORDER BY v[i] DESC, (i + b - 3) // 2 DESC) AS rest FROM cpl WHERE b IS NOT NULL AND v[b] < v[i] GROUP BY ALL),
cwalk AS (SELECT record_id, seg_idx, rest[1] AS p, list_filter(rest[2:], lambda q: abs(q - rest[1]) >= 6) AS rest FROM cst
  UNION ALL SELECT record_id, seg_idx, rest[1], list_filter(rest[2:], lambda q: abs(q - rest[1]) >= 6) FROM cwalk WHERE len(rest) > 0),
cshape AS (SELECT w.record_id, w.seg_idx, p, v, sd, n, coalesce(list_max(list_filter(range(0, p), lambda j: v[j + 1] > v[p + 1])) + 1, 0) AS ls,
  coalesce(list_min(list_filter(range(p + 1, n), lambda j: v[j + 1] > v[p + 1])) - 1, n - 1) AS rs FROM cwalk w JOIN carr c ON w.record_id = c.record_id AND w.seg_idx = c.seg_idx),
clow AS (SELECT *, list_min(v[ls + 1:p + 1]) AS ll, list_min(v[p + 1:rs + 1]) AS lr FROM cshape),
cprom AS (SELECT *, v[p + 1] - greatest(ll, lr) AS prom FROM clow),
cbase AS (SELECT *, v[p + 1] - prom * 0.9::DOUBLE AS lev, list_max(list_filter(range(ls, p + 1), lambda j: v[j + 1] = ll)) AS lb, list_min(list_filter(range(p, rs + 1), lambda j: v[j + 1] = lr)) AS rb FROM cprom WHERE prom >= sd * 0.5::DOUBLE),
ccross AS (SELECT *, coalesce(list_max(list_filter(range(lb, p + 1), lambda j: v[j + 1] <= lev)), lb) AS l, coalesce(list_min(list_filter(range(p, rb + 1), lambda j: v[j + 1] <= lev)), rb) AS r FROM cbase),
cends AS (SELECT *, l + CASE WHEN v[l + 1] < lev THEN (lev - v[l + 1]) / (v[l + 2] - v[l + 1]) ELSE 0 END AS a, r - CASE WHEN v[r + 1] < lev THEN (lev - v[r + 1]) / (v[r] - v[r + 1]) ELSE 0 END AS z FROM ccross),
contr AS (SELECT record_id, seg_idx, CAST(round_even(a, 0) AS BIGINT) AS onset, CAST(p AS BIGINT) AS peak, CAST(round_even(z, 0) AS BIGINT) AS "end" FROM cends WHERE (z - a) / 0.1::DOUBLE BETWEEN 45 AND 120)"""


@query("C11_contractions", f"WITH RECURSIVE {CLEAN}, {CONTRACTIONS} SELECT * FROM contr")
def contractions(spark, d):
    return C.contractions(clean(spark, d).withColumn("y", F.round("y", 9)), "y", FS)


# Events of the second channel that plain SQL can also find: two or more samples at 50 and above.
OTHERS = f"""other AS (SELECT record_id, seg_idx, start AS onset, "end" AS other_end FROM {runs_sql('clean', 'y >= 50', 2)}),
near AS (SELECT * EXCLUDE k FROM (SELECT d.record_id, d.seg_idx, start, "end", nadir, baseline - low AS depth, onset, other_end,
  row_number() OVER (PARTITION BY d.record_id, d.seg_idx, start ORDER BY abs(start - onset) NULLS LAST, onset NULLS LAST) AS k
  FROM down d LEFT JOIN other o ON d.record_id = o.record_id AND d.seg_idx = o.seg_idx) WHERE k = 1)"""


def nearest(spark, d):
    dev = materialize(base_and_dev(spark, d), "deviation")
    others = C.runs(dev, F.col("y") >= 50, 2).withColumnRenamed("start", "onset")
    return C.nearest_event(C.decelerations(dev, "x", FS), others)


@query("C12_nearest_event", f"""WITH RECURSIVE {CLEAN}, {DEV}, {DOWN}, {OTHERS}
SELECT record_id, seg_idx, start, "end", nadir, round(depth, 6) AS depth, onset, other_end FROM near""")
def nearest_event(spark, d):
    return rounded(nearest(spark, d), "depth")


KINDS = """kinds AS (SELECT *, CASE WHEN coalesce(start > onset + 2 AND start < other_end, false) THEN 'late' WHEN ("end" - start) / 0.1::DOUBLE < 180 THEN 'early'
  WHEN ("end" - start) / 0.1::DOUBLE <= 300 THEN 'prolonged' ELSE 'severe' END AS kind, nadir - start < 3 AS variable FROM near)"""


@query("C13_classify_events", f"""WITH RECURSIVE {CLEAN}, {DEV}, {DOWN}, {OTHERS}, {KINDS} SELECT record_id, seg_idx, start, "end", kind, variable FROM kinds""")
def classify_events(spark, d):
    return C.classify_events(nearest(spark, d), FS).select(*SEG, "start", "end", "kind", "variable")


NAMED = """named AS (SELECT record_id, seg_idx, target AS flag, CASE WHEN record_id % 13 = 0 THEN 'unknown.png'
  ELSE 'r' || (record_id % 7) || '_' || (seg_idx // 4) || '_p' || lpad(CAST(seg_idx + CASE WHEN missing_fraction > 0.4 THEN 1 ELSE 0 END AS VARCHAR), 3, '0') || '.png' END AS name FROM segments)"""


@query("C14_longest_contiguous_run", f"""WITH {NAMED},
p AS (SELECT *, regexp_extract(name, '^(.+)_p(\\d+)\\.png$', 1) AS pre, TRY_CAST(regexp_extract(name, '^(.+)_p(\\d+)\\.png$', 2) AS BIGINT) AS num FROM named),
q AS (SELECT *, lag(flag) OVER w AS pf, lag(pre) OVER w AS pp, lag(num) OVER w AS pn FROM p WINDOW w AS (PARTITION BY record_id ORDER BY seg_idx)),
r AS (SELECT *, CASE WHEN flag = 1 AND NOT coalesce(pf = 1 AND pp = pre AND pn + 1 = num, false) THEN 1 ELSE 0 END AS st FROM q),
u AS (SELECT *, sum(st) OVER (PARTITION BY record_id ORDER BY seg_idx) AS run FROM r),
v AS (SELECT record_id, run, sum(flag) AS len, count(*) FILTER (WHERE num IS NULL) AS unk FROM u GROUP BY ALL)
SELECT record_id, CASE WHEN sum(unk) = 0 THEN CAST(max(len) AS BIGINT) END AS longest_run, CASE WHEN sum(unk) = 0 THEN 'source_index_proxy' ELSE 'unknown_source_order' END AS continuity_status
FROM v GROUP BY record_id""")
def longest_contiguous(spark, d):
    index = F.col("seg_idx") + F.when(F.col("missing_fraction") > 0.4, 1).otherwise(0)
    name = F.when(F.col("record_id") % 13 == 0, "unknown.png").otherwise(F.concat(
        F.lit("r"), F.col("record_id") % 7, F.lit("_"), F.expr("seg_idx div 4"), F.lit("_p"), F.lpad(index.cast("string"), 3, "0"), F.lit(".png")))
    named = B.segments(spark, d).select(*SEG, F.col("target").alias("flag"), name.alias("name"))
    return C.longest_contiguous(named, memo=(d, "events", "user_id"))


@query("C15_concatenate_record", "SELECT record_id, seg_idx, sample_idx, x, row_number() OVER (PARTITION BY record_id ORDER BY seg_idx, sample_idx) - 1 AS record_sample FROM samples")
def concat_record(spark, d):
    return C.concat_record(signal(spark, d).drop("y"), memo=(d, "events", "user_id"))


@query("C16_window_contract", """SELECT record_id, seg_idx, count(*) AS n, count(*) = 10 AND max(sample_idx) - min(sample_idx) = 9 AND abs(count(*) * 10.0 - 100) < 1e-8 AS valid
FROM samples GROUP BY ALL""")
def window_contract(spark, d):
    return C.window_contract(signal(spark, d), 1 / FS, B.SEGMENT_SAMPLES, 100)


ARM = """SELECT record_id, seg_idx, avg(x) AS x_mean, min(x) AS x_min, max(x) AS x_max, stddev_pop(x) AS x_sd"""


@query("C17_arm_sensitivity", f"""WITH {CLEAN}, {CLEAN_0}, a AS ({ARM} FROM clean GROUP BY ALL), b AS ({ARM} FROM clean0 GROUP BY ALL),
j AS (SELECT 'x_mean' AS feature, a.x_mean AS a, b.x_mean AS b FROM a JOIN b USING (record_id, seg_idx) UNION ALL SELECT 'x_min', a.x_min, b.x_min FROM a JOIN b USING (record_id, seg_idx)
  UNION ALL SELECT 'x_max', a.x_max, b.x_max FROM a JOIN b USING (record_id, seg_idx) UNION ALL SELECT 'x_sd', a.x_sd, b.x_sd FROM a JOIN b USING (record_id, seg_idx))
SELECT feature, round(avg(abs(a - b)), 6) AS mean_abs_change, round(avg(CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction_left,
 round(avg(CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction_right FROM j GROUP BY feature""")
def arm_sensitivity(spark, d):
    arms = [X.moments(clean(spark, d, s), ["x"]) for s in (30, 0)]
    return rounded(C.arm_sensitivity(*arms, ["x_mean", "x_min", "x_max", "x_sd"]), "mean_abs_change", "zero_fraction_left", "zero_fraction_right")


# The training clusters of the segments, by the same split rule as the scored units.
TRAIN = """ts AS (SELECT cluster_id, max(target) AS stratum FROM segments GROUP BY 1),
tf AS (SELECT cluster_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || cluster_id)) - 1) % 10 AS fold FROM ts),
ti AS (SELECT cluster_id, (row_number() OVER (PARTITION BY stratum ORDER BY md5('43|' || cluster_id)) - 1) % 9 AS f FROM tf WHERE fold <> 0),
train AS (SELECT cluster_id FROM ti WHERE f <> 0)"""


def train_clusters(spark, d):
    return materialize(S.holdout_split(B.segments(spark, d)).where(F.col("split") == "train").select("cluster_id"), "train")


@query("C18_train_scaled", f"""WITH {TRAIN}, m AS (SELECT greatest(max(abs(x)), 1e-6) AS sx, greatest(max(abs(y)), 1e-6) AS sy FROM samples WHERE cluster_id IN (SELECT cluster_id FROM train))
SELECT record_id, seg_idx, sample_idx, round(x / sx, 6) AS x, round(y / sy, 6) AS y FROM samples CROSS JOIN m""")
def train_scaled(spark, d):
    rows = S.flag_member(B.samples(spark, d).select(*SEG, "sample_idx", "cluster_id", "x", "y"), train_clusters(spark, d), name="training")
    scale = C.fit_maxabs(rows, ["x", "y"], F.col("training"))
    return rounded(C.apply_scale(rows, scale, ["x", "y"]).drop("cluster_id", "training"), "x", "y")


@query("C19_segment_zscore", """SELECT record_id, seg_idx, sample_idx, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-6), 6) AS x,
round((y - avg(y) OVER w) / greatest(stddev_pop(y) OVER w, 1e-6), 6) AS y FROM samples WINDOW w AS (PARTITION BY record_id, seg_idx)""")
def segment_z(spark, d):
    return rounded(C.segment_z(signal(spark, d), ["x", "y"]), "x", "y")


# --- D: features -----------------------------------------------------------

@query("D01_moments", "SELECT record_id, seg_idx, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in "xy" for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_pop", "sd")))
       + " FROM samples GROUP BY ALL")
def moments(spark, d):
    out = X.moments(signal(spark, d), ["x", "y"])
    return rounded(out, *[c for c in out.columns if c not in SEG])


@query("D02_mean_abs_difference", f"WITH l AS (SELECT record_id, seg_idx, abs(x - lag(x) OVER ({P})) AS s FROM samples) SELECT record_id, seg_idx, round(avg(s), 6) AS masd FROM l GROUP BY ALL")
def masd(spark, d):
    return rounded(X.masd(signal(spark, d), "x"), "masd")


@query("D03_band_fractions", "SELECT record_id, seg_idx, round(avg(CASE WHEN x < 20 THEN 1.0 ELSE 0.0 END), 6) AS below_fraction, round(avg(CASE WHEN x > 100 THEN 1.0 ELSE 0.0 END), 6) AS above_fraction FROM samples GROUP BY ALL")
def band_fraction(spark, d):
    return rounded(X.band_fraction(signal(spark, d), "x", 20, 100), "below_fraction", "above_fraction")


def sizes(df):
    return df.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n"))


@query("D04_event_summary", f"""WITH RECURSIVE {CLEAN}, {DEV}, {DOWN}, n AS (SELECT record_id, seg_idx, count(*) AS n FROM clean GROUP BY ALL)
SELECT record_id, seg_idx, count(start) AS n_events, round(coalesce(max(baseline - low), 0), 6) AS max_depth, round(coalesce(sum("end" - start), 0) / max(n)::DOUBLE, 6) AS time_fraction
FROM n LEFT JOIN down USING (record_id, seg_idx) GROUP BY ALL""")
def event_summary(spark, d):
    dev = base_and_dev(spark, d)
    return rounded(X.event_summary(sizes(dev), C.decelerations(dev, "x", FS)), "max_depth", "time_fraction")


@query("D05_event_pivot", f"""WITH RECURSIVE {CLEAN}, {DEV}, {DOWN}, {OTHERS}, {KINDS}, n AS (SELECT DISTINCT record_id, seg_idx FROM clean)
SELECT record_id, seg_idx, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in X.EVENT_KINDS if k != "variable")
       + ", count(*) FILTER (WHERE variable) AS n_variable FROM n LEFT JOIN kinds USING (record_id, seg_idx) GROUP BY ALL")
def event_pivot(spark, d):
    return X.event_pivot(sizes(clean(spark, d)), C.classify_events(nearest(spark, d), FS))


def hist_sql(source: str) -> str:
    return f"""r AS (SELECT record_id, seg_idx, x, CASE WHEN min(x) OVER w = max(x) OVER w THEN min(x) OVER w - 0.5 ELSE min(x) OVER w END AS lo,
  CASE WHEN min(x) OVER w = max(x) OVER w THEN max(x) OVER w + 0.5 ELSE max(x) OVER w END AS hi FROM {source} WINDOW w AS (PARTITION BY record_id, seg_idx)),
g AS (SELECT *, (hi - lo) / 24 AS wd, floor((x - lo) / ((hi - lo) / 24)) AS k FROM r),
b AS (SELECT record_id, seg_idx, lo, wd, least(greatest(CASE WHEN x < lo + k * wd THEN k - 1 WHEN x >= lo + (k + 1) * wd THEN k + 1 ELSE k END, 0), 23) AS bin FROM g),
c AS (SELECT record_id, seg_idx, lo, wd, bin, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT record_id, seg_idx, lo, wd, (list(bin ORDER BY n DESC, bin))[1] AS k FROM c GROUP BY ALL)"""


HIST = hist_sql("samples")
HIST_MODE = """hm AS (SELECT record_id, seg_idx, max(x) - min(x) AS hist_width, median(x) AS hist_median, max(m.lo + (m.k + 0.5) * m.wd) AS hist_mode FROM r JOIN m USING (record_id, seg_idx) GROUP BY ALL)"""


@query("D06_histogram_mode", f"""WITH {HIST} SELECT record_id, seg_idx, round(max(x) - min(x), 6) AS hist_width, round(median(x), 6) AS hist_median, round(max(m.lo + (m.k + 0.5) * m.wd), 6) AS hist_mode
FROM r JOIN m USING (record_id, seg_idx) GROUP BY ALL""")
def hist_mode(spark, d):
    return rounded(X.hist_mode(signal(spark, d), "x"), "hist_width", "hist_median", "hist_mode")


@query("D07_zero_lag_correlation", """SELECT record_id, seg_idx, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) ELSE 0 END, 6) AS corr0 FROM samples GROUP BY ALL""")
def corr0(spark, d):
    return rounded(X.corr0(signal(spark, d)), "corr0")


def lag_sql(source: str) -> str:
    return f"""ln AS (SELECT record_id, seg_idx, count(*) AS n FROM {source} GROUP BY ALL),
ll AS (SELECT record_id, seg_idx, unnest(range(-least(6, n - 2), least(6, n - 2) + 1)) AS lag FROM ln WHERE n > 2 UNION ALL SELECT record_id, seg_idx, 0 FROM ln WHERE n <= 2),
lp AS (SELECT l.record_id, l.seg_idx, lag, CASE WHEN min(a.x) < max(a.x) AND min(b.y) < max(b.y) THEN corr(a.x, b.y) ELSE 0 END AS r
  FROM ll l JOIN {source} a ON a.record_id = l.record_id AND a.seg_idx = l.seg_idx JOIN {source} b ON b.record_id = l.record_id AND b.seg_idx = l.seg_idx AND a.sample_idx = b.sample_idx + lag GROUP BY ALL),
lq AS (SELECT record_id, seg_idx, lag, round(coalesce(r, 0), 9) AS r FROM lp),
lagged AS (SELECT record_id, seg_idx, min(r) AS corr_min, (list(lag ORDER BY r, lag <> 0, lag))[1] / 0.1::DOUBLE AS corr_min_lag_s FROM lq GROUP BY ALL)"""


@query("D08_min_lag_correlation", f"WITH {lag_sql('samples')} SELECT record_id, seg_idx, round(corr_min, 6) AS corr_min, round(corr_min_lag_s, 6) AS corr_min_lag_s FROM lagged")
def min_lag_corr(spark, d):
    return rounded(X.min_lag_corr(signal(spark, d), "x", "y", FS), "corr_min", "corr_min_lag_s")


CLASSIFIED = """near AS (SELECT * EXCLUDE k FROM (SELECT d.record_id, d.seg_idx, d.start, d."end", nadir, baseline - low AS depth, onset, o."end" AS other_end,
  row_number() OVER (PARTITION BY d.record_id, d.seg_idx, d.start ORDER BY abs(d.start - onset) NULLS LAST, onset NULLS LAST, o.peak NULLS LAST) AS k
  FROM down d LEFT JOIN contr o ON d.record_id = o.record_id AND d.seg_idx = o.seg_idx) WHERE k = 1)"""
# All but the lagged correlation, which is compared at nine decimals.
SHOWN_28 = [f for f in X.FEATURES_28 if f != "ft_corr_min"]


EVENTS = f"{DEV}, {VARIABILITY}, {DOWN}, {events_sql('dev >= 15 AND x > 0', 'up')}, {CONTRACTIONS}, {CLASSIFIED}, {KINDS}"
COUNTED = """fall AS (SELECT record_id, seg_idx, count(*) AS n_decel, max(baseline - low) AS decel_max_depth, sum("end" - start) AS t FROM down GROUP BY ALL),
rise AS (SELECT record_id, seg_idx, count(*) AS n_accel FROM up WHERE length < 60 AND peak - start < 3 GROUP BY ALL),
con AS (SELECT record_id, seg_idx, count(*) AS n_contractions FROM contr GROUP BY ALL),
kd AS (SELECT record_id, seg_idx, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}_decel" for k in X.EVENT_KINDS if k != "variable") + """, count(*) FILTER (WHERE variable) AS n_variable_decel FROM kinds GROUP BY ALL)"""
WIDE = f"""st AS (SELECT * REPLACE (round(y, 9) AS y), abs(x - lag(x) OVER ({P})) AS step FROM dev),
agg AS (SELECT record_id, seg_idx, count(*) AS n, avg(x) AS fhr_mean, min(x) AS fhr_min, max(x) AS fhr_max, stddev_pop(x) AS fhr_sd, avg(step) AS stv, avg(CASE WHEN x < 20 THEN 1.0 ELSE 0.0 END) AS brady_frac,
  avg(CASE WHEN x > 100 THEN 1.0 ELSE 0.0 END) AS tachy_frac, avg(y) AS toco_mean, max(y) AS toco_max, stddev_pop(y) AS toco_sd, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) ELSE 0 END AS ft_corr0,
  first(baseline) AS figo_baseline, max(x) - min(x) AS hist_width, median(x) AS hist_median FROM st GROUP BY ALL HAVING count(*) >= 2),
{COUNTED},
wide AS (SELECT agg.*, n_decel, decel_max_depth, t / n::DOUBLE AS decel_time_frac, n_accel, n_contractions, v AS figo_baseline_var, n_early_decel, n_late_decel, n_variable_decel, n_severe_decel, n_prolonged_decel
  FROM agg LEFT JOIN fall USING (record_id, seg_idx) LEFT JOIN rise USING (record_id, seg_idx) LEFT JOIN con USING (record_id, seg_idx) LEFT JOIN kd USING (record_id, seg_idx) LEFT JOIN var USING (record_id, seg_idx))"""


def as_sql_rounds(df, digits, *columns):
    """Decimals as SQL engines round: the scaled double, halves away from zero. A depth that is a half at the ninth decimal
    but for its last bit must not depend on how it is printed."""
    scale = 10.0 ** digits
    return df.select(*[(F.round(F.col(c) * scale) / scale).alias(c) if c in columns else F.col(c) for c in df.columns])


def eight_decimals(df, *columns):
    return as_sql_rounds(df, 8, *columns)


def shown_features(names: list, kept: str, digits: int) -> str:
    """Every feature rounded, 0 where nothing was found; the one kept stays NULL without valid samples."""
    return ", ".join(f"round(CAST({f if f == kept else f'coalesce({f}, 0)'} AS DOUBLE), {digits}) AS {f}" for f in names)


# Both channels at 9 decimals for what hinges on a bin edge or on a lag chosen between near-equal values.
NINE = "nine AS (SELECT record_id, seg_idx, sample_idx, round(x, 9) AS x, round(y, 9) AS y FROM clean)"
EVERY_28 = "every AS (SELECT w.*, hm.hist_mode, corr_min AS ft_corr_min, corr_min_lag_s AS ft_corr_min_lag_s FROM wide w JOIN hm USING (record_id, seg_idx) JOIN lagged USING (record_id, seg_idx))"


@query("D09_features28", f"""WITH RECURSIVE {CLEAN}, {EVENTS}, {WIDE}, {NINE}, {hist_sql('nine')}, {HIST_MODE}, {lag_sql('nine')},
{EVERY_28}
SELECT record_id, seg_idx, {shown_features(SHOWN_28, 'figo_baseline', 8)}, round(ft_corr_min, 6) AS ft_corr_min FROM every""")
def features28(spark, d):
    # A correlation of a channel that hardly moves has fewer sure digits than others: six, as D08 shows it.
    out = X.features28(clean(spark, d).withColumn("y", F.round("y", 9)), FS, 20, 100, decimals=9)
    return as_sql_rounds(eight_decimals(out, *SHOWN_28), 6, "ft_corr_min")


def exact(df):
    return df.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


@query("D09_feature_vector", f"""WITH RECURSIVE {exact_clean_sql(BASE)}, {EVENTS}, {WIDE}, {hist_sql('clean')}, {HIST_MODE}, {lag_sql('clean')},
{EVERY_28}
SELECT record_id, seg_idx, {shown_features(SHOWN_28, 'figo_baseline', 8)}, ft_corr_min FROM every""")
def feature_vector(spark, d):
    return eight_decimals(X.features28(exact(clean(spark, d)), FS, 20, 100), *SHOWN_28)


@query("D09_rejected_segments", "SELECT record_id, seg_idx, count(*) AS n, 'fewer_than_two_samples' AS reason FROM samples GROUP BY ALL HAVING count(*) < 2")
def rejected_segments(spark, d):
    return X.rejected_segments(signal(spark, d))


HOURS = "s AS (SELECT record_id, seg_idx // 3 AS seg_idx, (seg_idx % 3) * 10 + sample_idx AS sample_idx, x, y FROM samples)"


@query("D10_features17", f"""WITH RECURSIVE {exact_clean_sql(HOURS)}, {EVENTS}, {COUNTED}, valid AS (SELECT * FROM clean WHERE x > 0), {hist_sql('valid')}, {HIST_MODE},
hs AS (SELECT record_id, seg_idx, min(x) AS hist_min, max(x) AS hist_max, avg(x) AS hist_mean, stddev_pop(x) AS hist_std FROM valid GROUP BY ALL),
every AS (SELECT record_id, seg_idx, baseline, v AS baseline_variability, hs.* EXCLUDE (record_id, seg_idx), hm.* EXCLUDE (record_id, seg_idx), n_contractions AS n_uc, n_accel AS n_accelerations, n_decel AS n_decelerations,
  """ + ", ".join(f"n_{k}_decel AS n_{k}_decelerations" for k in X.EVENT_KINDS) + f""" FROM base LEFT JOIN var USING (record_id, seg_idx) LEFT JOIN hs USING (record_id, seg_idx) LEFT JOIN hm USING (record_id, seg_idx)
  LEFT JOIN con USING (record_id, seg_idx) LEFT JOIN rise USING (record_id, seg_idx) LEFT JOIN fall USING (record_id, seg_idx) LEFT JOIN kd USING (record_id, seg_idx))
SELECT record_id, seg_idx, {shown_features(X.FEATURES_17, 'baseline', 8)} FROM every""")
def features17(spark, d):
    """Three segments in a row stand in for the longer crops of this variant."""
    longer = signal(spark, d).select("record_id", F.expr("seg_idx div 3").alias("seg_idx"), F.expr("(seg_idx % 3) * 10 + sample_idx").alias("sample_idx"), "x", "y")
    return eight_decimals(X.features17(exact(C.preprocess(longer, ("x", "y"), FS)), FS), *X.FEATURES_17)


LONG = "long AS (" + " UNION ALL ".join(f"SELECT cluster_id, target, '{f}' AS feature, {f} AS value FROM segments" for f in B.SEGMENT_FEATURES) + ")"


@query("D11_feature_quality", f"""WITH {LONG} SELECT feature, count(*) AS n, count(DISTINCT cluster_id) AS clusters, count(DISTINCT CASE WHEN target = 1 THEN cluster_id END) AS positive_clusters,
count(DISTINCT CASE WHEN target = 0 THEN cluster_id END) AS negative_clusters, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction,
count(DISTINCT CASE WHEN value = 0 THEN cluster_id END) AS zero_clusters, count(DISTINCT CASE WHEN value <> 0 THEN cluster_id END) AS nonzero_clusters,
round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, count(DISTINCT round(value, 6)) AS n_unique, round(stddev_samp(value), 6) AS std,
CASE WHEN feature = 'n_high' THEN 'structurally_unobservable' WHEN count(DISTINCT value) <= 1 THEN 'constant' ELSE 'ok' END AS status FROM long GROUP BY feature""")
def feature_quality(spark, d):
    exact = B.segments(spark, d).select("cluster_id", "target", *[F.round(f, 6).alias(f) if f in ("x_mean", "y_mean", "missing_fraction") else F.col(f) for f in B.SEGMENT_FEATURES])
    return rounded(X.feature_quality(exact, B.SEGMENT_FEATURES, ("n_high",)), "zero_fraction", "min", "max", "mean", "std")


@query("D12_record_rollup", """SELECT record_id, count(*) AS n_segments, round(avg(target), 6) AS abnormal_fraction, max(target) AS any_abnormal, 1 - max(target) AS all_normal,
count(*) FILTER (WHERE missing_fraction <= 0.3) AS n_kept, round(avg(missing_fraction), 6) AS missing_fraction FROM segments GROUP BY record_id""")
def record_rollup(spark, d):
    return rounded(X.record_rollup(B.segments(spark, d)), "abnormal_fraction", "missing_fraction")


@query("D13_record_stats", "SELECT record_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, CAST(trunc(median({c})) AS INTEGER) AS median_{c}, CAST(trunc(avg({c})) AS INTEGER) AS mean_{c}" for c in "xy")
       + " FROM samples GROUP BY record_id")
def record_stats(spark, d):
    return X.record_stats(signal(spark, d), ["x", "y"], order=["seg_idx", "sample_idx"])


@query("D13_positive_share", """SELECT record_id, round_even(avg(target), 1) AS prop_abnormal FROM segments GROUP BY record_id""")
def positive_share(spark, d):
    return X.positive_share(B.segments(spark, d))


@query("D14_site_inventory", """SELECT site, count(*) AS records, count(DISTINCT cluster_id) AS clusters, CAST(coalesce(sum(any_abnormal), 0) AS BIGINT) AS positive_records,
CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS paired_records FROM records GROUP BY site""")
def site_inventory(spark, d):
    return X.site_inventory(B.records(spark, d).withColumn("paired", F.col("priority") == "1-URGENT"), paired="paired")


@query("D15_dataset_summary", """WITH r AS (SELECT record_id, count(*) FILTER (WHERE missing_fraction <= 0.3) AS k FROM segments GROUP BY 1)
SELECT count(DISTINCT record_id) AS records, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (WHERE missing_fraction <= 0.3) AS segments,
count(*) FILTER (WHERE missing_fraction <= 0.3 AND target = 1) AS positive_segments, count(*) FILTER (WHERE missing_fraction > 0.3) AS excluded_segments,
(SELECT count(*) FROM r WHERE k = 0) AS records_without_segments, count(*) FILTER (WHERE missing_fraction <= 0.3) > 0 AS usable_for_training FROM segments""")
def dataset_summary(spark, d):
    return X.dataset_summary(B.segments(spark, d))


FIELDS = ["balance", "price", "priority", "n_segments"]


@query("D16_missingness", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CASE WHEN '{f}' = 'balance' AND balance < 0 THEN '9999' ELSE CAST({f} AS VARCHAR) END AS value FROM records" for f in FIELDS) + """),
w AS (SELECT field, value, TRY_CAST(value AS DOUBLE) AS num FROM v)
SELECT field, count(value) AS present, count(*) FILTER (WHERE value IS NOT NULL AND (num IS NULL OR num = 9999)) AS missing,
count(*) FILTER (WHERE num IS NULL OR num = 9999) AS missing_or_absent FROM w GROUP BY field""")
def missingness(spark, d):
    rows = B.records(spark, d).withColumn("balance", F.when(F.col("balance") < 0, F.lit("9999")).otherwise(F.col("balance").cast("string")))
    return X.missingness(rows, FIELDS)


@query("D17_value_counts", """SELECT 'event_type' AS field, event_type AS value, count(*) AS count FROM samples GROUP BY event_type
UNION ALL SELECT 'y', CAST(CAST(y AS BIGINT) AS VARCHAR), count(*) FROM samples GROUP BY y""")
def value_counts(spark, d):
    return X.field_counts(B.samples(spark, d).withColumn("y", F.col("y").cast("bigint")), ["event_type", "y"])
