"""Features of a segment derived inside its own row.

A segment's samples are packed once into short arrays by the only exchange of
the plan; baseline, runs, peaks, event kinds, histogram and lagged correlation
are then column expressions over these arrays. Nothing is unpacked, joined or
written in between. Arrays are as long as a segment, which is fixed by contract.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import signal as C

RUN = "struct<start:bigint,end:bigint,length:bigint,low:double,high:double,nadir:bigint,peak:bigint>"


def pack(df: DataFrame, *aggregates: Column, keys: Sequence[str] = C.SEGMENT, order: str = C.ORDER) -> DataFrame:
    """One row per segment: arrays ``_i`` (positions), x and y in order, and any aggregates of its samples."""
    samples = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    grouped = df.groupBy(*keys).agg(samples.alias("_s"), *aggregates)
    field = lambda f: F.transform("_s", lambda s: s[f])
    return grouped.withColumn("_i", field("i")).withColumn("x", field("x")).withColumn("y", field("y")).drop("_s")


def runs_in_row(samples: str, hit: str) -> Column:
    """Maximal runs of consecutive positions whose sample v (i, x, dev, keep) is a hit, with the extremes inside.

    The lowest and highest sample of a run are its first on ties. A sample that
    is no hit leaves the open run alone: the next hit's position ends it.
    """
    closed = "CASE WHEN s.open IS NULL THEN s.done ELSE array_append(s.done, s.open) END"
    fresh = "named_struct('start', v.i, 'end', v.i + 1, 'length', 1L, 'low', v.x, 'high', v.x, 'nadir', v.i, 'peak', v.i)"
    longer = """named_struct('start', s.open.start, 'end', s.open.`end` + 1, 'length', s.open.length + 1, 'low', least(s.open.low, v.x), 'high', greatest(s.open.high, v.x),
        'nadir', CASE WHEN v.x < s.open.low THEN v.i ELSE s.open.nadir END, 'peak', CASE WHEN v.x > s.open.high THEN v.i ELSE s.open.peak END)"""
    return F.expr(f"""aggregate({samples}, named_struct('done', CAST(array() AS array<{RUN}>), 'open', CAST(NULL AS {RUN})),
        (s, v) -> CASE WHEN NOT coalesce({hit}, false) THEN s
            WHEN s.open.`end` = v.i THEN named_struct('done', s.done, 'open', {longer})
            ELSE named_struct('done', {closed}, 'open', {fresh}) END,
        s -> {closed})""")


def variability_in_row(samples: str) -> Column:
    """Mean absolute difference of successive turning points inside runs of kept samples, 0 without any."""
    sign = "CASE WHEN v.x <> s.x THEN signum(v.x - s.x) END"
    turned = f"coalesce({sign} <> s.sign, false)"
    gap = f"CASE WHEN {turned} THEN abs(s.x - s.turn) END"
    nothing = "CAST(NULL AS DOUBLE)"
    return F.expr(f"""aggregate({samples}, named_struct('end', CAST(NULL AS BIGINT), 'x', {nothing}, 'sign', {nothing}, 'turn', {nothing}, 'total', 0D, 'n', 0),
        (s, v) -> CASE WHEN NOT v.keep THEN s
            WHEN s.`end` = v.i THEN named_struct('end', v.i + 1, 'x', v.x, 'sign', coalesce({sign}, s.sign), 'turn', CASE WHEN {turned} THEN s.x ELSE s.turn END,
                'total', s.total + coalesce({gap}, 0D), 'n', s.n + CAST(({gap}) IS NOT NULL AS INT))
            ELSE named_struct('end', v.i + 1, 'x', v.x, 'sign', {nothing}, 'turn', {nothing}, 'total', s.total, 'n', s.n) END,
        s -> coalesce(try_divide(s.total, s.n), 0D))""")


def with_events(packed: DataFrame, fs: float) -> DataFrame:
    """Adds baseline, baseline_variability, and the arrays falls (with kind and variable), rises and contractions."""
    ready = C._with_baseline(packed, "x", fs)
    base, mask = F.col("_final.base"), F.col("_final.mask")
    sample = lambda i, v: F.struct(i.alias("i"), v.alias("x"), (v - base).alias("dev"),
                                   F.coalesce((F.abs(v - mask) < C.EVENT_DEPTH) & (v != 0), F.lit(False)).alias("keep"))
    ready = C.with_contractions(ready.withColumn("_samples", F.zip_with("_i", "x", sample)), "y", fs)
    shortest = math.ceil(C.EVENT_MIN_SECONDS * fs)
    down = runs_in_row("_samples", f"v.dev <= {-C.EVENT_DEPTH}D AND v.x > 0")
    up = runs_in_row("_samples", f"v.dev >= {C.EVENT_DEPTH}D AND v.x > 0")
    rise = lambda r: ((r["length"] >= shortest) & (r["length"] < C.EVENT_MAX_SECONDS * fs)
                      & (r["peak"] - r["start"] < C.RISE_TO_PEAK_SECONDS * fs))

    def met(r):
        """The contraction whose onset is nearest to the start; on ties the earlier onset, then the earlier peak."""
        return F.array_min(F.transform("contractions", lambda c: F.struct(
            F.abs(r["start"] - c["onset"]).alias("far"), c["onset"].alias("onset"), c["peak"].alias("peak"), c["end"].alias("end"))))

    def judged(r):
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["nadir"].alias("nadir"), r["depth"].alias("depth"),
                        C.event_kind(r["start"], r["end"], r["met"]["onset"], r["met"]["end"], fs).alias("kind"),
                        C.is_variable(r["start"], r["nadir"], fs).alias("variable"))

    falls = F.transform(F.filter(down, lambda r: r["length"] >= shortest), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["nadir"].alias("nadir"), (base - r["low"]).alias("depth"), met(r).alias("met")))
    found = ready.withColumn("falls", falls).withColumn("rises", F.filter(up, rise)).withColumn("baseline_variability", variability_in_row("_samples"))
    return (found.withColumn("falls", F.transform("falls", judged)).withColumn("baseline", base).drop("_samples", "_final"))


def with_histogram(arrays: DataFrame, values: Column, bins: int) -> DataFrame:
    """Adds hist_width, hist_median and hist_mode of the values of each row, NULL where it has none.

    The mode is the middle of the first fullest of equal bins over [min, max]; a
    constant is binned over its value +/- 0.5. Sorted values meet their bins in
    rising order, so one pass counts them.
    """
    held = arrays.withColumn("_v", F.array_sort(F.filter(values, lambda v: v.isNotNull())))
    n = F.size("_v")
    low, high = F.get("_v", F.lit(0)), F.get("_v", n - 1)
    flat = low == high
    held = held.withColumn("_range", F.struct(F.when(flat, low - 0.5).otherwise(low).alias("lo"), F.when(flat, high + 0.5).otherwise(high).alias("hi")))
    held = held.withColumn("_bins", F.struct(F.col("_range.lo").alias("lo"), ((F.col("_range.hi") - F.col("_range.lo")) / bins).alias("width")))
    edge = "(_bins.lo + ({}) * _bins.width)"
    guess = "floor((v - _bins.lo) / _bins.width)"
    bin_of = f"""least(greatest(CASE WHEN v < {edge.format(guess)} THEN {guess} - 1 WHEN v >= {edge.format(guess + " + 1")} THEN {guess} + 1 ELSE {guess} END, 0L), {bins - 1}L)"""
    best = F.expr(f"""aggregate(transform(_v, v -> {bin_of}), named_struct('bin', CAST(NULL AS BIGINT), 'n', 0, 'best', CAST(NULL AS BIGINT), 'most', 0),
        (s, k) -> CASE WHEN coalesce(s.bin = k, false) THEN named_struct('bin', k, 'n', s.n + 1, 'best', CASE WHEN s.n + 1 > s.most THEN k ELSE s.best END, 'most', greatest(s.n + 1, s.most))
            ELSE named_struct('bin', k, 'n', 1, 'best', CASE WHEN 1 > s.most THEN k ELSE s.best END, 'most', greatest(1, s.most)) END,
        s -> s.best)""")
    lo, width = F.col("_bins.lo"), F.col("_bins.width")
    middle = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    return (held.withColumn("hist_width", high - low).withColumn("hist_median", middle)
            .withColumn("hist_mode", lo + (best + 0.5) * width).drop("_v", "_range", "_bins"))


def mean_step(values: Column | str) -> Column:
    """Mean absolute difference of successive values, NULL below two."""
    column = F.col(values) if isinstance(values, str) else values
    steps = F.filter(F.transform(column, lambda v, i: F.abs(v - F.get(column, i - 1))), lambda s: s.isNotNull())
    return F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))


def paired_moments(x: str = "x", y: str = "y") -> Column:
    """Struct of mx, my, sx, sy (means and population deviations, NULL without samples) and r, the correlation, of two arrays.

    Samples are taken in order by running means, so the result never hangs on the order in which rows arrived: where a
    channel is constant but for the last bit, another order gives another correlation. r is 0 when a side is constant.
    """
    mean = lambda c: f"(s.m{c} + (v.{c} - s.m{c}) / (s.n + 1))"
    square = lambda c: f"s.q{c} + (v.{c} - {mean(c)}) * (v.{c} - s.m{c})"
    zeros = ", ".join(f"'{f}', 0D" for f in ("tx", "ty", "mx", "my", "qx", "qy", "c"))
    deviation = lambda c: f"sqrt(try_divide(s.q{c}, s.n))"
    return F.expr(f"""aggregate(zip_with({x}, {y}, (a, b) -> named_struct('x', a, 'y', b)), named_struct('n', 0, {zeros}),
        (s, v) -> named_struct('n', s.n + 1, 'tx', s.tx + v.x, 'ty', s.ty + v.y, 'mx', {mean("x")}, 'my', {mean("y")},
            'qx', {square("x")}, 'qy', {square("y")}, 'c', s.c + (v.y - s.my) * (v.x - {mean("x")})),
        s -> named_struct('mx', try_divide(s.tx, s.n), 'my', try_divide(s.ty, s.n), 'sx', {deviation("x")}, 'sy', {deviation("y")},
            'r', CASE WHEN array_min({x}) < array_max({x}) AND array_min({y}) < array_max({y})
                THEN coalesce(try_divide(s.c / s.n, {deviation("x")} * {deviation("y")}), 0D) ELSE 0D END))""")


def event_counts(suffix: str, kinds: Sequence[str]) -> list[Column]:
    """Falls per kind; 'variable' counts independently of the main kind."""
    hit = lambda kind: (lambda r: r["variable"]) if kind == "variable" else (lambda r: r["kind"] == kind)
    return [F.size(F.filter("falls", hit(k))).alias(f"n_{k}_{suffix}") for k in kinds]
