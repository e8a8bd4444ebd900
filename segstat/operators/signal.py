"""Windowed-signal operators: runs, gap filling, smoothing, baseline and events.

The unit is a segment, a short window of fixed length, keyed (record_id,
seg_idx) and ordered by sample_idx; a partition of these windows never grows
with the data. All windows of a chain share one exchange on the segment key.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ratio
from ..plans.ordering import has_oversized, ordered_index, previous_row, running_totals

SEGMENT = ("record_id", "seg_idx")
ORDER = "sample_idx"

# Event thresholds in signal units and seconds.
EVENT_DEPTH = 15.0
EVENT_MIN_SECONDS = 15
RISE_TO_PEAK_SECONDS = 30
EVENT_MAX_SECONDS = 600
LATE_DELAY_SECONDS = 20
EARLY_MAX_SECONDS = 180
PROLONGED_MAX_SECONDS = 300
VARIABLE_NADIR_SECONDS = 30
SHORT_GAP_SECONDS = 15
SMOOTH_SECONDS = 30
BASELINE_SECONDS = 600
BASELINE_TOLERANCE = 0.5
BASELINE_ROUNDS = 50
CONTRACTION_SECONDS = (45, 120)
PEAK_DISTANCE_SECONDS = 60
PEAK_PROMINENCE_SD = 0.5
PEAK_WIDTH_LEVEL = 0.9


def runs(df: DataFrame, pred: Column, min_len: int = 1, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Maximal runs [start, end) of rows where the predicate holds, at least min_len long."""
    held = df.where(pred)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (held.select(*keys, order, island.alias("_island")).groupBy(*keys, "_island")
            .agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count(F.lit(1)).alias("length"))
            .where(F.col("length") >= min_len).drop("_island"))


def longest_run(df: DataFrame, pred: Column, name: str = "longest", keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Length of the longest run per segment, 0 where there is none."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(pred, F.lit(False))
    island = F.sum((~hit).cast("int")).over(window)
    return (df.select(*keys, hit.alias("_hit"), island.alias("_island")).groupBy(*keys, "_island")
            .agg(F.count_if("_hit").alias("_length")).groupBy(*keys).agg(F.max("_length").alias(name)))


def longest_flat(df: DataFrame, value: str, name: str = "longest_flat", keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Longest stretch of equal, finite, non-zero values; a single value counts 1."""
    window = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    usable = F.coalesce((v != 0) & ~F.isnan(v), F.lit(False))
    same = usable & F.coalesce(v == F.lag(v).over(window), F.lit(False))
    island = F.sum((~F.col("_same")).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (df.select(*keys, order, usable.alias("_usable"), same.alias("_same")).withColumn("_island", island)
            .groupBy(*keys, "_island").agg(F.count_if("_usable").alias("_length"))
            .groupBy(*keys).agg(F.max("_length").alias(name)))


def impute_gaps(df: DataFrame, columns: Sequence[str], max_gap: int | None = None, valid=lambda v: v != 0,
                keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Linear filling of missing runs up to max_gap samples (None: any length).

    Runs at an edge take the one neighbour; longer runs and all-missing
    segments stay as they are.
    """
    forward = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    known = {c: F.when(valid(F.col(c)), F.struct(F.col(order).alias("i"), F.col(c).alias("v"))) for c in columns}
    df = df.select("*", *[F.last(known[c], ignorenulls=True).over(forward).alias(f"_left_{c}") for c in columns],
                   F.min(order).over(whole).alias("_first"), F.max(order).over(whole).alias("_last"))
    df = df.select("*", *[F.last(known[c], ignorenulls=True).over(backward).alias(f"_right_{c}") for c in columns])
    out = []
    for c in columns:
        left, right = F.col(f"_left_{c}"), F.col(f"_right_{c}")
        start = F.coalesce(left["i"] + 1, F.col("_first"))
        stop = F.coalesce(right["i"], F.col("_last") + 1)
        length = stop - start
        filled = F.when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(
            left["v"] + (right["v"] - left["v"]) * ratio(F.col(order) - left["i"], length + 1))
        fits = F.lit(True) if max_gap is None else length <= max_gap
        out.append(F.when(valid(F.col(c)) | ~fits, F.col(c)).otherwise(F.coalesce(filled, F.col(c))).alias(c))
    kept = [f for f in df.columns if not f.startswith(("_left_", "_right_")) and f not in ("_first", "_last")]
    return df.select(*[next(o for o, name in zip(out, columns) if name == f) if f in columns else F.col(f) for f in kept])


def smooth(df: DataFrame, columns: Sequence[str], window: int, weights: Sequence[float] | None = None,
           keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Centred mean over valid (non-zero) samples; missing samples stay 0."""
    if window <= 1:
        return df
    before, after = window // 2, (window - 1) // 2
    ordered = Window.partitionBy(*keys).orderBy(order)

    def smoothed(c: str) -> Column:
        valid = F.when(F.col(c) != 0, F.col(c))
        if weights is None:
            mean = F.avg(valid).over(ordered.rowsBetween(-before, after))
        else:
            # A convolution meets the kernel backwards: offset +after pairs with the first weight.
            terms = [(w, F.lead(valid, after - k).over(ordered)) for k, w in enumerate(weights)]
            numerator = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in terms), F.lit(0.0))
            denominator = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, v in terms), F.lit(0.0))
            mean = F.try_divide(numerator, denominator)
        return F.when(F.col(c) != 0, mean).otherwise(F.lit(0.0)).alias(c)

    return df.select(*[smoothed(f) if f in columns else F.col(f) for f in df.columns])


def preprocess(df: DataFrame, columns: Sequence[str] = ("x", "y"), fs: float = 0.5, smooth_seconds: int = SMOOTH_SECONDS) -> DataFrame:
    """Short gaps filled, then smoothed (or not), then every remaining gap filled."""
    if smooth_seconds not in (0, SMOOTH_SECONDS):
        raise ValueError("smoothing arms are 0 and 30 seconds")
    filled = impute_gaps(df, columns, int(SHORT_GAP_SECONDS * fs))
    if smooth_seconds:
        filled = smooth(filled, columns, int(smooth_seconds * fs))
    return impute_gaps(filled, columns, None)


def interp_primary(df: DataFrame, primary: str = "x") -> DataFrame:
    """Every gap of the primary channel filled; the other channel keeps its zeros."""
    return impute_gaps(df, [primary], None, valid=lambda v: v > 0)


def segment_arrays(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """One row per segment with its samples in order; arrays are as short as a segment."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    # A transform, unlike "_s.c", is not repeated inside every expression that reads the array.
    field = lambda c: F.transform("_s", lambda s: s[c]).alias(c)
    return df.groupBy(*keys).agg(packed.alias("_s")).select(*keys, *[field(c) for c in columns])


def _sum_count(values: Column, keep) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(values, start, lambda a, v: F.when(keep(v), F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))


def _with_baseline(arrays: DataFrame, column: str, fs: float) -> DataFrame:
    """Adds struct ``_final`` (base, mask) to rows that hold a segment's samples as an array."""
    first = F.slice(F.filter(column, lambda v: v > 0), 1, max(1, int(BASELINE_SECONDS * fs)))
    seeded = arrays.withColumn("_open", _sum_count(first, lambda v: F.lit(True))).withColumn(
        "_base", F.try_divide(F.col("_open.s"), F.col("_open.n")))
    state = F.struct(F.col("_base").alias("base"), F.col("_base").alias("mask"), F.lit(False).alias("done"))
    bind = lambda value, body: F.transform(F.array(value), body)[0]

    def step(s, _):
        kept = _sum_count(F.col(column), lambda v: (F.abs(v - s["base"]) < EVENT_DEPTH) & (v != 0))
        fresh = bind(kept, lambda k: bind(F.coalesce(F.try_divide(k["s"], k["n"]), s["base"]), lambda m: F.struct(
            m.alias("base"), s["base"].alias("mask"), (F.abs(m - s["base"]) < BASELINE_TOLERANCE).alias("done"))))
        return F.when(s["done"], s).otherwise(fresh)

    final = F.aggregate(F.sequence(F.lit(1), F.lit(BASELINE_ROUNDS)), state, step)
    return seeded.withColumn("_final", F.when(F.col("_base").isNotNull(), final)).drop("_open", "_base")


def baseline(df: DataFrame, column: str = "x", fs: float = 0.5, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Iterated robust baseline per segment, NULL where nothing is valid.

    Starts from the mean of the first valid samples; events (deviation of 15 or
    more) and zeros are dropped and the mean recomputed until it moves less than
    0.5. ``mask_base`` is the value the last keep-mask was judged against.
    """
    return _with_baseline(segment_arrays(df, [column], keys, order), column, fs).select(
        *keys, F.col("_final.base").alias("baseline"), F.col("_final.mask").alias("mask_base"))


def deviations(df: DataFrame, column: str = "x", fs: float = 0.5, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Samples with their segment's baseline, deviation and keep-mask.

    The segment is packed, its baseline found, and unpacked again: no join, and
    the samples are computed once.
    """
    others = [c for c in df.columns if c not in (*keys, order, column)]
    arrays = segment_arrays(df, [order, column, *others], keys, order)
    ready = _with_baseline(arrays, column, fs)
    rows = ready.select(*keys, F.col("_final.base").alias("baseline"), F.col("_final.mask").alias("_mask"),
                        F.inline(F.arrays_zip(order, column, *others)))
    kept = (F.abs(F.col(column) - F.col("_mask")) < EVENT_DEPTH) & (F.col(column) != 0)
    return rows.withColumn("dev", F.col(column) - F.col("baseline")).withColumn("keep", F.coalesce(kept, F.lit(False))).drop("_mask")


def baseline_variability(df: DataFrame, column: str = "x", keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Mean absolute difference of successive turning points inside keep-runs of 3 or more samples."""
    kept = df.where("keep")
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    run = [*keys, "_run"]
    w = Window.partitionBy(*run).orderBy(order)
    steps = (kept.withColumn("_run", island)
             .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*run))).where(F.col("_size") >= 3)
             .withColumn("_before", F.lag(column).over(w))
             .withColumn("_sign", F.when(F.col(column) != F.col("_before"), F.signum(F.col(column) - F.col("_before")))))
    earlier = F.last("_sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turns = steps.withColumn("_earlier", earlier).where(F.col("_sign") != F.col("_earlier"))
    gaps = turns.withColumn("_gap", F.abs(F.col("_before") - F.lag("_before").over(w)))
    found = gaps.groupBy(*keys).agg(F.avg("_gap").alias("baseline_variability"))
    return df.select(*keys).distinct().join(found, list(keys), "left").fillna(0.0, ["baseline_variability"])


def _events(df: DataFrame, pred: Column, min_len: int, column: str, keys: Sequence[str], order: str) -> DataFrame:
    """Runs of the predicate with the extreme of the channel inside them."""
    held = df.where(pred)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    at_least = F.struct(F.col(column), F.col(order))
    at_most = F.struct(-F.col(column), F.col(order))
    return (held.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count(F.lit(1)).alias("length"),
        F.min_by(F.col(order), at_least).alias("nadir"), F.min_by(F.col(order), at_most).alias("peak"),
        F.min(column).alias("low"), F.max(column).alias("high"), F.first("baseline").alias("baseline"))
        .where(F.col("length") >= min_len).drop("_island"))


def accelerations(df: DataFrame, column: str = "x", fs: float = 0.5, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Rises of 15 or more for 15 s or longer, under 600 s, peaking within 30 s."""
    found = _events(df, (F.col("dev") >= EVENT_DEPTH) & (F.col(column) > 0), math.ceil(EVENT_MIN_SECONDS * fs), column, keys, order)
    return found.where((F.col("length") < EVENT_MAX_SECONDS * fs) & (F.col("peak") - F.col("start") < RISE_TO_PEAK_SECONDS * fs)).select(
        *keys, "start", "end", "peak", "high")


def decelerations(df: DataFrame, column: str = "x", fs: float = 0.5, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Drops of 15 or more for 15 s or longer, with their nadir and depth."""
    found = _events(df, (F.col("dev") <= -EVENT_DEPTH) & (F.col(column) > 0), math.ceil(EVENT_MIN_SECONDS * fs), column, keys, order)
    return found.select(*keys, "start", "end", "nadir", (F.col("baseline") - F.col("low")).alias("depth"))


def nearest_event(events: DataFrame, others: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Each event with the contraction whose onset is nearest to its start; earlier onset, then earlier end on ties.

    Both sides hold a handful of events per segment; the join never leaves the segment.
    """
    joined = events.join(others.select(*keys, "onset", F.col("end").alias("other_end")), list(keys), "left")
    order = Window.partitionBy(*keys, "start").orderBy(F.abs(F.col("start") - F.col("onset")).asc_nulls_last(), F.col("onset").asc_nulls_last(), F.col("other_end").asc_nulls_last())
    return joined.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1).drop("_k")


def event_kind(start: Column, end: Column, onset: Column, other_end: Column, fs: float) -> Column:
    seconds = (end - start) / fs
    late = F.coalesce((start > onset + LATE_DELAY_SECONDS * fs) & (start < other_end), F.lit(False))
    return F.when(late, "late").when(seconds < EARLY_MAX_SECONDS, "early").when(seconds <= PROLONGED_MAX_SECONDS, "prolonged").otherwise("severe")


def is_variable(start: Column, nadir: Column, fs: float) -> Column:
    return (nadir - start) < VARIABLE_NADIR_SECONDS * fs


def classify_events(nearest: DataFrame, fs: float = 0.5) -> DataFrame:
    """late / early / prolonged / severe, and independently variable."""
    kind = event_kind(F.col("start"), F.col("end"), F.col("onset"), F.col("other_end"), fs)
    return nearest.withColumn("kind", kind).withColumn("variable", is_variable(F.col("start"), F.col("nadir"), fs))


def longest_contiguous(df: DataFrame, name: str = "name", flag: str = "flag", record: str = "record_id", order: str = "seg_idx",
                       limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """Longest run of flagged segments per record whose source names count on without a break.

    A run ends at a negative, a change of prefix or a skipped index. A record
    with any name of unknown form gets NULL and a status instead of a guess.
    """
    pattern = r"^(.+)_[pP](\d+)(?:\.[pP][nN][gG])?$"
    parsed = df.select(record, order, F.col(flag).alias("_flag"), F.regexp_extract(name, pattern, 1).alias("_prefix"),
                       F.expr(f"try_cast(regexp_extract({name}, '{pattern.replace(chr(92), chr(92) * 2)}', 2) AS bigint)").alias("_number"))
    before = previous_row(parsed, [record], [order], ["_flag", "_prefix", "_number"], "_p", limit, memo)
    goes_on = (F.col("_p_flag") == 1) & (F.col("_p_prefix") == F.col("_prefix")) & (F.col("_p_number") + 1 == F.col("_number"))
    marked = before.withColumn("_start", ((F.col("_flag") == 1) & ~F.coalesce(goes_on, F.lit(False))).cast("bigint"))
    slim = marked.select(record, order, "_flag", "_start", "_number")
    if has_oversized(slim, [record], limit, memo):
        numbered = running_totals(slim, [record], order, ["_start"]).withColumnRenamed("cum__start", "_run")
    else:
        window = Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        numbered = slim.withColumn("_run", F.sum("_start").over(window))
    per_run = numbered.groupBy(record, "_run").agg(F.sum("_flag").alias("_length"), F.count_if(F.col("_number").isNull()).alias("_unknown"))
    total = per_run.groupBy(record).agg(F.max("_length").alias("_longest"), F.sum("_unknown").alias("_unknown"))
    known = F.col("_unknown") == 0
    return total.select(record, F.when(known, F.col("_longest")).cast("bigint").alias("longest_run"),
                        F.when(known, "source_index_proxy").otherwise("unknown_source_order").alias("continuity_status"))


def concat_record(df: DataFrame, record: str = "record_id", limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """Samples numbered through their record in source order."""
    return ordered_index(df, [record], ["seg_idx", ORDER], "record_sample", limit, memo)


def window_contract(df: DataFrame, dt: float, samples: int, seconds: float, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Whether each segment has the agreed sample count and duration, and gapless positions."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(order) - F.min(order) + 1).alias("span"))
    return got.select(*keys, "n", ((F.col("n") == samples) & (F.col("span") == samples) & (F.abs(F.col("n") * F.lit(float(dt)) - seconds) < 1e-8)).alias("valid"))


def arm_sensitivity(left: DataFrame, right: DataFrame, features: Sequence[str], keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Per feature: mean absolute change between two arms, and the share of zeros in each."""
    renamed = right.select(*keys, *[F.col(f).alias("_b_" + f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("a"), F.col("_b_" + f).cast("double").alias("b")) for f in features])
    long = left.join(renamed, list(keys)).select(F.inline(rows))
    return long.groupBy("feature").agg(
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_change"),
        F.avg((F.col("a") == 0).cast("double")).alias("zero_fraction_left"), F.avg((F.col("b") == 0).cast("double")).alias("zero_fraction_right"))


def fit_maxabs(df: DataFrame, channels: Sequence[str], training: Column, floor: float = 1e-6) -> DataFrame:
    """One row with each channel's largest magnitude over training rows."""
    return df.where(training).agg(*[F.greatest(F.max(F.abs(F.col(c))), F.lit(floor)).alias("scale_" + c) for c in channels])


def apply_scale(df: DataFrame, scale: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Divides every row by the fitted scales (a single-row subquery)."""
    return df.select(*[(F.col(c) / scale.select("scale_" + c).scalar()).alias(c) if c in channels else F.col(c) for c in df.columns])


def segment_z(df: DataFrame, channels: Sequence[str], floor: float = 1e-6, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Per-segment z-scores with the population deviation, floored."""
    w = Window.partitionBy(*keys)
    return df.select(*[((F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(floor))).alias(c) if c in channels else F.col(c)
                       for c in df.columns])


def contractions(df: DataFrame, column: str = "y", fs: float = 0.5, keys: Sequence[str] = SEGMENT, order: str = ORDER) -> DataFrame:
    """Bell-shaped peaks of the second channel: (onset, peak, end) per segment.

    Local maxima at least 60 s apart (the highest kept first), prominence of at
    least half a standard deviation, 45-120 s wide at 90 % of the prominence.
    Each is worked out on the segment's own short array, inside the JVM.
    """
    return with_contractions(segment_arrays(df, [column], keys, order), column, fs).select(*keys, F.inline("contractions"))


def with_contractions(arrays: DataFrame, column: str = "y", fs: float = 0.5, name: str = "contractions") -> DataFrame:
    """Adds the peaks of an array column as an array of (onset, peak, end), empty where there are none."""
    distance = max(1, math.ceil(int(PEAK_DISTANCE_SECONDS * fs)))
    stats = F.aggregate(column, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n")),
                        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), (a["n"] + 1).alias("n")))
    n = F.size(column)
    # 0-based positions; plateaus count once, at their middle, when both sides are lower.
    at = lambda i: F.get(F.col(column), i)
    positions = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    rises = F.filter(positions, lambda i: at(i - 1) < at(i))
    ends = F.transform(rises, lambda i: F.struct(
        i.alias("a"), F.coalesce(F.array_min(F.filter(F.sequence(i, n - 1), lambda j: at(j) != at(i))), n).alias("b")))
    tops = F.filter(ends, lambda p: (p["b"] < n) & (F.coalesce(at(p["b"]), F.lit(float("inf"))) < at(p["a"])))
    peaks = F.transform(tops, lambda p: F.struct((-at(p["a"])).alias("h"), (-F.floor((p["a"] + p["b"] - 1) / 2)).cast("int").alias("p")))
    # Highest first; between equals the later one.
    ranked = F.array_sort(peaks)
    spaced = F.aggregate(ranked, F.array().cast("array<int>"), lambda kept, p: F.when(
        F.exists(kept, lambda q: F.abs(q + p["p"]) < distance), kept).otherwise(F.concat(kept, F.array(-p["p"]))))

    def shape(p):
        left_stop = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), p), lambda j: at(j) > at(p))) + 1, F.lit(0))
        right_stop = F.coalesce(F.array_min(F.filter(F.sequence(p, n - 1), lambda j: at(j) > at(p))) - 1, n - 1)
        lows = lambda a, b: F.array_min(F.transform(F.sequence(a, b), lambda j: at(j)))
        return F.struct(p.alias("p"), left_stop.alias("ls"), right_stop.alias("rs"),
                        (at(p) - F.greatest(lows(left_stop, p), lows(p, right_stop))).alias("prom"))

    def bases(s):
        """The lowest sample on each side, nearest to the peak; the walk outward stops there."""
        def base(a, b, nearest):
            low = F.array_min(F.transform(F.sequence(a, b), at))
            return nearest(F.filter(F.sequence(a, b), lambda j: at(j) == low))
        return F.struct(s["p"].alias("p"), (at(s["p"]) - s["prom"] * PEAK_WIDTH_LEVEL).alias("level"),
                        base(s["ls"], s["p"], F.array_max).alias("lb"), base(s["p"], s["rs"], F.array_min).alias("rb"))

    def crossings(s):
        under = lambda a, b: F.filter(F.sequence(a, b), lambda j: at(j) <= s["level"])
        return F.struct(s["p"].alias("p"), s["level"].alias("level"),
                        F.coalesce(F.array_max(under(s["lb"], s["p"])), s["lb"]).alias("l"),
                        F.coalesce(F.array_min(under(s["p"], s["rb"])), s["rb"]).alias("r"))

    def limits(s):
        part = lambda i, inner: F.when(at(i) < s["level"], F.try_divide(s["level"] - at(i), at(inner) - at(i))).otherwise(0.0)
        return F.struct(s["p"].alias("p"), (s["l"] + part(s["l"], s["l"] + 1)).alias("on"), (s["r"] - part(s["r"], s["r"] - 1)).alias("off"))

    low, high = CONTRACTION_SECONDS
    sd = F.sqrt(F.greatest(F.col("_st.q") / F.col("_st.n") - F.pow(F.col("_st.s") / F.col("_st.n"), 2), F.lit(0.0)))
    shaped = arrays.withColumn("_st", stats).withColumn("_sd", sd).withColumn("_kept", F.array_sort(spaced)).withColumn("_p", F.transform("_kept", shape))
    prominent = F.filter("_p", lambda s: (F.col("_sd") > 0) & (s["prom"] >= F.col("_sd") * PEAK_PROMINENCE_SD))
    wide = shaped.withColumn("_p", F.transform(prominent, bases)).withColumn("_p", F.transform("_p", crossings)).withColumn("_p", F.transform("_p", limits))
    found = F.transform(F.filter("_p", lambda s: ((s["off"] - s["on"]) / fs).between(low, high)), lambda s: F.struct(
        F.bround(s["on"], 0).cast("bigint").alias("onset"), s["p"].cast("bigint").alias("peak"), F.bround(s["off"], 0).cast("bigint").alias("end")))
    return wide.withColumn(name, found).drop("_st", "_sd", "_kept", "_p")
