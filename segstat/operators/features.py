"""Per-segment features, their quality audit, and record / site rollups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import numeric_or_null, ratio
from ..plans.ordering import exact_quantiles, null_safe_join, ordered_means
from . import segment_row as R, signal as C

# Feature names, the shorter prefix, and the predeclared groups.
FEATURES_28 = [
    "fhr_mean", "fhr_min", "fhr_max", "fhr_sd", "stv", "brady_frac", "tachy_frac",
    "n_decel", "decel_max_depth", "decel_time_frac", "n_accel",
    "toco_mean", "toco_max", "toco_sd", "n_contractions",
    "ft_corr0", "ft_corr_min", "ft_corr_min_lag_s",
    "figo_baseline", "figo_baseline_var", "n_early_decel", "n_late_decel",
    "n_variable_decel", "n_severe_decel", "n_prolonged_decel",
    "hist_width", "hist_median", "hist_mode",
]
FEATURES_18 = FEATURES_28[:18]
GROUPS = {
    "signal": ["fhr_mean", "fhr_min", "fhr_max", "fhr_sd"],
    "baseline": ["figo_baseline", "hist_median", "hist_mode", "hist_width"],
    "variability": ["stv", "figo_baseline_var"],
    "range": ["brady_frac", "tachy_frac"],
    "events": ["n_decel", "decel_max_depth", "decel_time_frac", "n_accel",
               "n_early_decel", "n_late_decel", "n_variable_decel", "n_severe_decel", "n_prolonged_decel"],
    "contractions_coupling": ["toco_mean", "toco_max", "toco_sd", "n_contractions",
                              "ft_corr0", "ft_corr_min", "ft_corr_min_lag_s"],
}
FEATURES_17 = [
    "n_uc", "baseline", "baseline_variability",
    "n_accelerations", "n_decelerations", "n_early_decelerations",
    "n_variable_decelerations", "n_severe_decelerations",
    "n_late_decelerations", "n_prolonged_decelerations",
    "hist_width", "hist_min", "hist_max", "hist_median",
    "hist_mean", "hist_mode", "hist_std",
]
EVENT_KINDS = ["early", "late", "variable", "prolonged", "severe"]
LOW_BAND, HIGH_BAND = 110.0, 160.0
HISTOGRAM_BINS = 24
MAX_LAG_SECONDS = 60


def robust_features() -> list[str]:
    """The features that do not depend on event or baseline detection."""
    fragile = {*GROUPS["events"], "n_contractions", "figo_baseline", "figo_baseline_var"}
    return [f for f in FEATURES_28 if f not in fragile]


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns
                                   for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"), (F.stddev_pop, "sd"))])


def masd(df: DataFrame, column: str, keys: Sequence[str] = C.SEGMENT, order: str = C.ORDER) -> DataFrame:
    """Mean absolute difference of successive samples."""
    step = F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(order)))
    return df.select(*keys, step.alias("_step")).groupBy(*keys).agg(F.avg("_step").alias("masd"))


def band_fraction(df: DataFrame, column: str, low: float = LOW_BAND, high: float = HIGH_BAND, keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    share = lambda hit: F.avg(hit.cast("double"))
    return df.groupBy(*keys).agg(share(F.col(column) < low).alias("below_fraction"), share(F.col(column) > high).alias("above_fraction"))


def event_summary(segments: DataFrame, events: DataFrame, keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    """Count, largest depth (0 without events) and share of time in events; ``segments`` carries n."""
    found = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("depth").alias("_d"), F.sum(F.col("end") - F.col("start")).alias("_t"))
    return segments.join(found, list(keys), "left").select(
        *keys, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_events"), F.coalesce("_d", F.lit(0.0)).alias("max_depth"),
        F.coalesce(ratio(F.col("_t"), F.col("n")), F.lit(0.0)).alias("time_fraction"))


def event_pivot(segments: DataFrame, classified: DataFrame, keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    """Counts per event kind; 'variable' counts independently of the main kind."""
    count = lambda kind: F.count_if(F.col("variable") if kind == "variable" else F.col("kind") == kind)
    counted = classified.groupBy(*keys).agg(*[count(k).alias(f"n_{k}") for k in EVENT_KINDS])
    return segments.select(*keys).join(counted, list(keys), "left").fillna(0, [f"n_{k}" for k in EVENT_KINDS])


def hist_mode(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    """Width, median and mode: the middle of the first fullest of equal bins over [min, max].

    A constant series is binned over its value +/- 0.5.
    """
    w = Window.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    flat = low == high
    ranged = df.select(*keys, F.col(column).alias("_v"), F.when(flat, low - 0.5).otherwise(low).alias("_lo"), F.when(flat, high + 0.5).otherwise(high).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    guess = F.floor((F.col("_v") - F.col("_lo")) / width)
    edge = lambda k: F.col("_lo") + k * width
    bin_no = F.when(F.col("_v") < edge(guess), guess - 1).when(F.col("_v") >= edge(guess + 1), guess + 1).otherwise(guess)
    per_bin = ranged.groupBy(*keys, "_lo", "_hi", F.least(F.greatest(bin_no, F.lit(0)), F.lit(bins - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    best = per_bin.groupBy(*keys, "_lo", "_hi").agg(F.min_by("_bin", F.struct(-F.col("_n"), F.col("_bin"))).alias("_k"))
    mode = best.select(*keys, (F.col("_lo") + (F.col("_k") + 0.5) * width).alias("hist_mode"))
    rest = df.groupBy(*keys).agg((F.max(column) - F.min(column)).alias("hist_width"), F.median(column).alias("hist_median"))
    return rest.join(mode, list(keys))


def corr0_of(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, 0 when a side is constant or there is a single sample."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(F.lit(0.0))


def corr0(df: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = C.SEGMENT) -> DataFrame:
    return df.groupBy(*keys).agg(corr0_of(x, y).alias("corr0"))


def min_lag_corr(df: DataFrame, x: str = "x", y: str = "y", fs: float = 0.5, max_lag: int = MAX_LAG_SECONDS,
                 keys: Sequence[str] = C.SEGMENT, order: str = C.ORDER) -> DataFrame:
    """Smallest lagged correlation and its lag in seconds; lag 0 is the incumbent, then ascending lags.

    Correlations are compared at 9 decimals, so rounding dust does not pick the lag.
    """
    # All lags of a segment are compared inside its row: nothing is exploded or grouped again.
    arrays = C.segment_arrays(df, [x, y], keys, order).withColumn("_n", F.size(x))
    best = arrays.select(*keys, best_lag(x, y, fs, max_lag).alias("_best"))
    return best.select(*keys, F.col("_best.r").alias("corr_min"), (F.col("_best.lag") / F.lit(float(fs))).alias("corr_min_lag_s"))


def best_lag(x: str, y: str, fs: float, max_lag: int = MAX_LAG_SECONDS) -> Column:
    """(r, shifted, lag) of the smallest lagged correlation of two array columns of length ``_n``."""
    step = max(1, round(fs))
    limit = F.least(F.lit(int(max_lag * fs)), F.col("_n") - 2)
    lags = F.when(limit > 0, F.array_union(F.array(F.lit(0)), F.transform(
        F.sequence(F.lit(0), F.floor(limit * 2 / step).cast("int")), lambda k: -limit + k * step))).otherwise(F.array(F.lit(0)))
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))

    def sums(p: Column) -> Column:
        add = lambda s, v: F.struct(
            (s["ab"] + (v["a"] - p["ma"]) * (v["b"] - p["mb"])).alias("ab"),
            (s["aa"] + (v["a"] - p["ma"]) * (v["a"] - p["ma"])).alias("aa"),
            (s["bb"] + (v["b"] - p["mb"]) * (v["b"] - p["mb"])).alias("bb"))
        return F.aggregate(F.arrays_zip(p["a"], p["b"]), zero, add)

    def score(p: Column) -> Column:
        varied = (F.array_min(p["a"]) < F.array_max(p["a"])) & (F.array_min(p["b"]) < F.array_max(p["b"]))
        r = bind(sums(p), lambda s: F.try_divide(s["ab"], F.sqrt(s["aa"]) * F.sqrt(s["bb"])))
        return F.round(F.when(varied, r).otherwise(F.lit(0.0)), 9)

    def of_lag(lag: Column) -> Column:
        size = F.col("_n") - F.abs(lag)
        pair = F.struct(F.slice(x, F.greatest(lag, F.lit(0)) + 1, size).alias("a"), F.slice(y, F.greatest(-lag, F.lit(0)) + 1, size).alias("b"))
        r = bind(pair, lambda p: bind(F.struct(p["a"].alias("a"), p["b"].alias("b"), mean(p["a"]).alias("ma"), mean(p["b"]).alias("mb")), score))
        return F.struct(r.alias("r"), (lag != 0).alias("shifted"), lag.alias("lag"))

    return F.array_min(F.transform(lags, of_lag))


def features28(df: DataFrame, fs: float = 0.5, low: float = LOW_BAND, high: float = HIGH_BAND, decimals: int | None = None) -> DataFrame:
    """The 28 features of preprocessed samples with columns x and y, one row per segment of two or more samples.

    One exchange on the segment key packs the samples; all events are found in the row. With ``decimals`` the histogram's mode
    and the lagged correlation see samples rounded so: a sample's last bit then picks neither a bin nor a lag.
    """
    keys = list(C.SEGMENT)
    share = lambda hit: F.avg(hit.cast("double"))
    packed = R.pack(df, F.count(F.lit(1)).alias("n"), F.min("x").alias("fhr_min"), F.max("x").alias("fhr_max"), F.max("y").alias("toco_max"),
                    share(F.col("x") < low).alias("brady_frac"), share(F.col("x") > high).alias("tachy_frac")).where(F.col("n") >= 2)
    packed = packed.withColumn("_both", R.paired_moments())
    rows = R.with_histogram(R.with_events(packed, fs), F.col("x"), HISTOGRAM_BINS).withColumn("_n", F.size("x"))
    if decimals is None:
        rows = rows.withColumn("_lag", best_lag("x", "y", fs))
    else:
        kept = ["hist_width", "hist_median"]
        rows = rows.withColumn("_kept", F.struct(*kept)).withColumns({f"_{c}": F.transform(c, lambda v: F.round(v, decimals)) for c in "xy"})
        rows = R.with_histogram(rows, F.col("_x"), HISTOGRAM_BINS).withColumns({f: F.col(f"_kept.{f}") for f in kept})
        rows = rows.withColumn("_lag", best_lag("_x", "_y", fs))
    depths = F.transform("falls", lambda r: r["depth"])
    held = F.aggregate("falls", F.lit(0).cast("bigint"), lambda s, r: s + (r["end"] - r["start"]))
    derived = rows.select(
        *keys, *[c for c in FEATURES_28 if c in rows.columns], R.mean_step("x").alias("stv"),
        *[F.col(f"_both.{f}").alias(name) for f, name in (("mx", "fhr_mean"), ("sx", "fhr_sd"), ("my", "toco_mean"), ("sy", "toco_sd"), ("r", "ft_corr0"))],
        F.size("falls").alias("n_decel"), F.coalesce(F.array_max(depths), F.lit(0.0)).alias("decel_max_depth"), (held / F.col("n")).alias("decel_time_frac"),
        F.size("rises").alias("n_accel"), F.size("contractions").alias("n_contractions"),
        F.col("_lag.r").alias("ft_corr_min"), (F.col("_lag.lag") / F.lit(float(fs))).alias("ft_corr_min_lag_s"),
        F.col("baseline").alias("figo_baseline"), F.col("baseline_variability").alias("figo_baseline_var"), *R.event_counts("decel", EVENT_KINDS))
    return derived.select(*keys, *[F.col(f).cast("double").alias(f) for f in FEATURES_28])


def features17(df: DataFrame, fs: float = 4.0) -> DataFrame:
    """The 17-feature variant: same rules at another rate, histogram over valid samples only."""
    keys = list(C.SEGMENT)
    valid = F.when(F.col("x") > 0, F.col("x"))
    packed = R.pack(df, F.min(valid).alias("hist_min"), F.max(valid).alias("hist_max"))
    kept = R.paired_moments("filter(x, k -> k > 0)", "filter(x, k -> k > 0)")
    packed = packed.withColumn("_kept", kept).withColumn("hist_mean", F.col("_kept.mx")).withColumn("hist_std", F.col("_kept.sx")).drop("_kept")
    rows = R.with_histogram(R.with_events(packed, fs), F.filter("x", lambda v: v > 0), HISTOGRAM_BINS)
    derived = rows.select(*keys, *[c for c in FEATURES_17 if c in rows.columns], F.size("contractions").alias("n_uc"), F.size("rises").alias("n_accelerations"),
                          F.size("falls").alias("n_decelerations"), *R.event_counts("decelerations", EVENT_KINDS))
    zero = [f for f in FEATURES_17 if f != "baseline"]
    return derived.fillna(0, zero).select(*keys, *[F.col(f).cast("double").alias(f) for f in FEATURES_17])


def rejected_segments(df: DataFrame) -> DataFrame:
    """Segments that ``features28`` leaves out, with their sample count and the reason."""
    counted = df.groupBy(*C.SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") < 2).withColumn("reason", F.lit("fewer_than_two_samples"))


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(rows))


def feature_quality(df: DataFrame, features: Sequence[str], unobservable: Sequence[str] = ("n_severe_decel",),
                    cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    """Descriptive audit per feature. Distinct clusters are counted in two steps, never as one set."""
    long = long_features(df, features, [cluster, target])
    per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    unique = per_value.groupBy("feature").agg(F.count("value").alias("n_unique"))
    per_cluster = long.groupBy("feature", cluster).agg(
        F.count(F.lit(1)).alias("c"), F.sum(target).alias("pos"), F.count_if(F.col("value") == 0).alias("zeros"),
        F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("m"))
    audit = per_cluster.groupBy("feature").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("pos") > 0).alias("positive_clusters"),
        F.count_if(F.col("c") > F.col("pos")).alias("negative_clusters"), (F.sum("zeros") / F.sum("c")).alias("zero_fraction"),
        F.count_if(F.col("zeros") > 0).alias("zero_clusters"), F.count_if(F.col("c") > F.col("zeros")).alias("nonzero_clusters"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), ratio(F.sum("s"), F.sum("m")).alias("mean"))
    spread = long.groupBy("feature").agg(F.stddev_samp("value").alias("std"))
    status = F.when(F.col("feature").isin(*unobservable), "structurally_unobservable").when(F.col("n_unique") <= 1, "constant").otherwise("ok")
    return audit.join(unique, "feature").join(spread, "feature").withColumn("status", status)


def record_rollup(df: DataFrame, max_missing: float = 0.3, record: str = "record_id") -> DataFrame:
    return df.groupBy(record).agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg(F.col("target").cast("double")).alias("abnormal_fraction"),
        F.max("target").alias("any_abnormal"), (1 - F.max("target")).alias("all_normal"),
        F.count_if(F.col("missing_fraction") <= max_missing).alias("n_kept"), F.avg("missing_fraction").alias("missing_fraction"))


def record_stats(df: DataFrame, channels: Sequence[str], record: str = "record_id", order: Sequence[str] | None = None) -> DataFrame:
    """min / max / integer median / integer mean per channel of a record.

    Medians come from counts of distinct readings in order, so no task holds a whole record. With ``order`` readings are added
    in that order and both lose their fraction as they stand: a sum that ends a bit below 62 readings' worth gives 61, as a
    plain loop and SQL's ``trunc(avg)`` do. Without it both are judged at nine decimals first, since the sum's last bit then
    hangs on how the rows arrived.
    """
    whole = (lambda c: c.cast("int")) if order else (lambda c: F.round(c, 9).cast("int"))
    bounds = df.groupBy(record).agg(*[f(c).alias(f"{k}_{c}") for c in channels for k, f in (("min", F.min), ("max", F.max))],
                                    *([] if order else [F.avg(c).alias(f"mean_{c}") for c in channels]))
    simple = null_safe_join(bounds, ordered_means(df, [record], order, channels), [record]) if order else bounds
    long = df.select(record, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])))
    middle = exact_quantiles(long, [record, "channel"], "value", [0.5], ["median"])
    wide = middle.groupBy(record).agg(*[F.max(F.when(F.col("channel") == c, F.col("median"))).alias(f"median_{c}") for c in channels])
    stats = null_safe_join(simple, wide, [record], "left")
    return stats.select(record, *[(whole(F.col(n)).alias(n) if k in ("median", "mean") else F.col(n))
                                  for c in channels for k in ("min", "max", "median", "mean") for n in [f"{k}_{c}"]])


def positive_share(df: DataFrame, record: str = "record_id", target: str = "target") -> DataFrame:
    """Positive share per record, rounded half-even to one decimal."""
    return df.groupBy(record).agg(F.bround(F.avg(F.col(target).cast("double")), 1).alias("prop_abnormal"))


def site_inventory(df: DataFrame, site: str = "site", cluster: str = "cluster_id", positive: str = "any_abnormal", paired: str | None = None) -> DataFrame:
    sums = [F.sum(positive).alias("positive_records")] + ([F.sum(F.col(paired).cast("int")).alias("paired_records")] if paired else [])
    per_cluster = df.groupBy(site, cluster).agg(F.count(F.lit(1)).alias("records"), *sums)
    return per_cluster.groupBy(site).agg(F.sum("records").alias("records"), F.count(cluster).alias("clusters"),
                                         *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("positive_records",) + (("paired_records",) if paired else ())])


def dataset_summary(segments: DataFrame, max_missing: float = 0.3) -> DataFrame:
    """One row: records, clusters, kept, positive and excluded segments, and whether training is possible."""
    kept = F.col("missing_fraction") <= max_missing
    per_record = segments.groupBy("cluster_id", "record_id").agg(
        F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("target") == 1)).alias("positive"), F.count_if(~kept).alias("excluded"))
    per_cluster = per_record.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kept") == 0).alias("empty"),
                                                       *[F.sum(c).alias(c) for c in ("kept", "positive", "excluded")])
    return per_cluster.agg(
        F.sum("records").alias("records"), F.count(F.lit(1)).alias("clusters"), F.sum("kept").alias("segments"),
        F.sum("positive").alias("positive_segments"), F.sum("excluded").alias("excluded_segments"),
        F.sum("empty").alias("records_without_segments"), (F.sum("kept") > 0).alias("usable_for_training"))


def missingness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: present, missing (sentinel or non-numeric) and missing-or-absent, over all records."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.inline(rows)).groupBy("field").agg(
        F.count("value").alias("present"),
        F.count_if(F.col("value").isNotNull() & numeric_or_null(F.col("value")).isNull()).alias("missing"),
        F.count_if(numeric_or_null(F.col("value")).isNull()).alias("missing_or_absent"))


def field_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Frequency of every value of the named fields."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.inline(rows)).where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
