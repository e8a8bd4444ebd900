"""Exact ordered computations that survive hot groups.

Row numbers, running sums and quantiles normally need a whole group in one
task. Here the rows of large groups are dealt over many tasks by Spark's own range
partitioning over (keys, order), which sorts NULL, NaN and strings as a
window does; each task's part of a group gets the total of the parts before it as an
offset. Results equal the plain window form, whatever the keys and order values are.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialize

# Rows one task may order for one group before the group is dealt over tasks.
HOT_GROUP_ROWS = 4_000_000
# Rows of a large table that one task sorts or groups.
ROWS_PER_TASK = 1_000_000
# Leading hex digits of a digest used as its range: 16 ** 3 equal shares.
DIGEST_DIGITS = 3

_probed: dict[tuple, bool] = {}


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where NULL equals NULL; keys are kept once."""
    if not keys:
        return left.join(right.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), how).drop("_one")
    renamed = right.select([F.col(c).alias("_r_" + c if c in keys else c) for c in right.columns])
    condition = None
    for key in keys:
        term = F.col(key).eqNullSafe(F.col("_r_" + key))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*["_r_" + key for key in keys])


def has_oversized(df: DataFrame, keys: Sequence[str], limit: int | None = None, memo: tuple | None = None) -> bool:
    """Whether any group exceeds the limit. Runs one combined count over the key columns.

    The answer only picks between two exact plans, so remembering it per table is safe.
    """
    limit = HOT_GROUP_ROWS if limit is None else limit
    slot = (df.sparkSession.sparkContext.applicationId, limit, *memo) if memo else None
    if slot in _probed:
        return _probed[slot]
    found = bool(df.groupBy(*keys).count().where(F.col("count") > limit).select("count").head(1))
    if slot:
        _probed[slot] = found
    return found


def spread(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """The rows dealt by the keys over as many tasks as hold ``per_task`` of ``rows`` each, never fewer than the session's."""
    count = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
    return df.repartition(count, *keys)


def spread_large(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """As ``spread``, but only where the session's partitions would hold more than ``ROWS_PER_TASK`` rows each; a smaller
    table is left to the engine. What sorts or groups by these keys then needs no other exchange, and a task's memory
    stays the same however large the table is."""
    if rows <= ROWS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return spread(df, rows, ROWS_PER_TASK, *keys)


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``_range``: the number of a task that holds consecutive rows in the given order.

    Rows that agree in keys and order share a task. The number is part of a
    written table, so it stays the same when a task is repeated.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn("_range", F.spark_partition_id().cast("bigint")), "ranges")


def _offsets(cells: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of the ranges before each range: a handful of rows per group."""
    totals = cells.groupBy(*keys, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias("_before_" + s) for s in sums],
        *[F.sum(s).over(whole).alias("total_" + s) for s in sums],
    )


def running_totals(points: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], *,
                   descending: bool = False, limit: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_*`` and group sums ``total_*`` over the order column.

    ``points`` has one row per (keys, order value): an aggregate, usually far
    smaller than its source. It is written once, since it is read several
    times. If no group exceeds the limit one window does.
    """
    limit = HOT_GROUP_ROWS if limit is None else limit
    points = materialize(points, "points")
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if points.count() <= limit or not has_oversized(points, keys, limit):
        part = Window.partitionBy(*(keys or [F.lit(0)]))
        running = part.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return points.select("*", *[F.sum(s).over(running).alias("cum_" + s) for s in sums],
                             *[F.sum(s).over(part).alias("total_" + s) for s in sums])
    cells = _dealt(points, keys, [direction])
    merged = null_safe_join(cells, _offsets(cells, keys, sums), [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    return merged.select(
        *points.columns,
        *[(F.sum(s).over(inside) + F.col("_before_" + s)).alias("cum_" + s) for s in sums],
        *["total_" + s for s in sums],
    )


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i",
                  limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """0-based position of each row within its group.

    Groups within the limit take one window; the rows of oversized groups are
    dealt over tasks. NULL is a key like any other, and NULL order values come first.
    """
    limit = HOT_GROUP_ROWS if limit is None else limit
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    if not has_oversized(df, keys, limit, memo):
        return df.withColumn(name, plain)
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).drop("count")
    cold = null_safe_join(df, hot, keys, "left_anti").withColumn(name, plain)
    cells = _dealt(null_safe_join(df, hot, keys, "left_semi"), keys, [F.col(c).asc() for c in order])
    ones = cells.select(*keys, "_range", F.lit(1).cast("bigint").alias("n"))
    starts = _offsets(ones, keys, ["n"]).select(*keys, "_range", F.col("_before_n").alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = null_safe_join(cells, starts, [*keys, "_range"]) \
        .withColumn(name, F.row_number().over(inside).cast("bigint") - 1 + F.col("_start"))
    return cold.unionByName(placed.select(*cold.columns))


def _folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """One row per group of aggregates whose rows are taken in the given order."""
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*keys, *[v.over(whole).alias(name) for name, v in values.items()]).groupBy(*keys).agg(*[F.max(name).alias(name) for name in values])


def ordered_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "mean_",
                  limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """Mean per group of each column, its doubles added one by one in the given order, so the last bit is that of a plain
    running sum however the rows arrive.

    The rows of oversized groups are dealt over tasks: each part is added in order, then the parts are, in theirs.
    """
    limit = HOT_GROUP_ROWS if limit is None else limit
    plain = {prefix + c: F.avg(c) for c in columns}
    if not has_oversized(df, keys, limit, memo):
        return _folded(df, keys, order, **plain)
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).drop("count")
    cold = _folded(null_safe_join(df, hot, keys, "left_anti"), keys, order, **plain)
    cells = _dealt(null_safe_join(df, hot, keys, "left_semi"), keys, [F.col(c).asc() for c in order])
    sums = {f"_sum_{c}": F.sum(c) for c in columns} | {f"_n_{c}": F.count(c) for c in columns}
    parts = _folded(cells, [*keys, "_range"], order, **sums)
    totals = _folded(parts, keys, ["_range"], **{name: F.sum(name) for name in sums})
    return cold.unionByName(totals.select(*keys, *[F.try_divide(f"_sum_{c}", f"_n_{c}").alias(prefix + c) for c in columns]))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_",
                 limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """Adds the columns of the preceding row. Oversized groups use an equi-join on consecutive positions."""
    if not has_oversized(df, keys, limit, memo):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(window).alias(prefix + c) for c in columns])
    # Written, so that both sides of the join see the same positions where order values tie.
    placed = materialize(ordered_index(df, keys, order, "_at", limit), "placed")
    shifted = placed.select(*keys, (F.col("_at") + 1).alias("_at"), *[F.col(c).alias(prefix + c) for c in columns])
    return null_safe_join(placed, shifted, [*keys, "_at"], "left").drop("_at")


def digest_index(df: DataFrame, keys: Sequence[str], digest: str, name: str = "i", limit: int | None = None) -> DataFrame:
    """0-based position by a hex digest within few, large groups.

    Digests are uniform, so their leading digits are equal shares of a group.
    Counting first is cheap for the callers: they pass a written table.
    """
    if not has_oversized(df, keys, limit):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(digest)).cast("bigint") - 1)
    cells = df.withColumn("_range", F.substring(digest, 1, DIGEST_DIGITS))
    ones = cells.select(*keys, "_range", F.lit(1).cast("bigint").alias("n"))
    starts = _offsets(ones, keys, ["n"]).select(*keys, "_range", F.col("_before_n").alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(digest)
    return (null_safe_join(cells, starts, [*keys, "_range"])
            .withColumn(name, F.row_number().over(inside).cast("bigint") - 1 + F.col("_start"))
            .drop("_range", "_start"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(counted.alias("n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, from counts of distinct values. A whole ``weight`` says how many rows a row stands for."""
    counted = running_totals(value_counts(df, keys, value, weight), keys, value, ["n"])
    aggregates = []
    for p, name in zip(probs, names):
        spot = (F.col("total_n") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("cum_n") > F.floor(spot), F.col(value)))
        high = F.min(F.when(F.col("cum_n") > F.ceil(spot), F.col(value)))
        share = F.max(spot - F.floor(spot))
        # Weighted, not low plus a step: the middle of 10.45 and 11.55 is 11, not a bit above or below.
        between = F.when(share == 0, low).otherwise(low * (1 - share) + high * share)
        aggregates.append(between.cast("double").alias(name))
    return counted.groupBy(*keys).agg(*aggregates)


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """From counts ``n`` per (keys, value): the average rank that ties share, and the group size."""
    counted = running_totals(counts.select(*keys, value, "n"), keys, value, ["n"])
    return counted.select(*keys, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name), F.col("total_n").alias("group_rows"))
