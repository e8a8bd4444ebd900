"""Joins and set operations with their cardinality and coverage checked."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import finite


def join_m1(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left many-to-one join, and the right keys that break its cardinality."""
    violations = right.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return left.join(right, list(on), "left"), violations


def join_11(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One-to-one join, and the keys that either side repeats.

    ``complete`` says whether the right side had the key. Keys the right side repeats stay unmatched: rows never multiply.
    """
    several = lambda df, side: df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).withColumn("side", F.lit(side))
    violations = several(left, "left").unionByName(several(right, "right"))
    values = [c for c in right.columns if c not in on]
    single = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in values]).where(F.col("_rows") == 1)
    return left.join(single, list(on), "left").withColumn("complete", F.col("_rows").isNotNull()).drop("_rows"), violations


def cohort_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose presence, count or compared values differ between two cohorts.

    Both sides are stacked and combined per key, so repeated keys cannot multiply.
    """
    side = lambda df, name: df.select(*keys, *columns, F.lit(int(name == "a")).alias("_a"), F.lit(int(name == "b")).alias("_b"))
    stacked = side(a, "a").unionByName(side(b, "b"))
    spread = [F.min(c).alias("_lo_" + c) for c in columns] + [F.max(c).alias("_hi_" + c) for c in columns] + [F.count(c).alias("_n_" + c) for c in columns]
    merged = stacked.groupBy(*keys).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"), *spread)
    differs = F.lit(False)
    for c in columns:
        rows = F.col("n_left") + F.col("n_right")
        known = (F.col("_n_" + c) == 0) | (F.col("_n_" + c) == rows)
        differs = differs | ~known | F.coalesce(F.col("_lo_" + c) != F.col("_hi_" + c), F.lit(False))
    problem = (F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate_key").when(F.col("n_left") == 0, "only_right")
               .when(F.col("n_right") == 0, "only_left").when(differs, "value_mismatch"))
    return merged.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def common_subset(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def exclude_clusters(df: DataFrame, held: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.join(held.select(cluster).distinct(), cluster, "left_anti")


def stack_tables(*dfs: DataFrame) -> DataFrame:
    merged = dfs[0]
    for df in dfs[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def id_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def id_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def to_long(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """``score__m`` / ``threshold__m`` column pairs to one row per model."""
    pairs = [f"{p}__{m}" for m in models for p in ("score", "threshold")]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col("score__" + m).alias("score"), F.col("threshold__" + m).alias("threshold")) for m in models])
    return df.select(*[c for c in df.columns if c not in pairs], F.inline(rows))


def to_wide(df: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}__{m}")
    return df.groupBy(*keys).agg(*[pick(m, c) for m in models for c in ("score", "threshold")])


def prior_cohort(records: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Sorted distinct valid cluster ids."""
    from .contracts import require_cluster
    return require_cluster(records, cluster).select(F.trim(F.col(cluster).cast("string")).alias(cluster)).distinct().orderBy(cluster)


def order_by(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark keeps k candidates per task before it shuffles."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def arg_first(df: DataFrame, by: Sequence[str], value: str, order: str, largest: bool = True, name: str = "at") -> DataFrame:
    """Position of the extreme value, the first one on ties."""
    key = F.struct((-F.col(value)) if largest else F.col(value), F.col(order))
    return df.groupBy(*by).agg(F.min_by(F.col(order), key).alias(name))
