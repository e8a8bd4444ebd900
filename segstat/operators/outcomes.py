"""Association of record-level readings with outcomes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import ratio
from ..plans.ordering import exact_quantiles, null_safe_join
from ..sources.scratch import materialize
from . import metrics as M


def cohort_descriptors(df: DataFrame, by: Sequence[str], reading: str, cluster: str = "cluster_id") -> DataFrame:
    """Records, clusters, and records / clusters per reading in each cohort."""
    r = F.col(reading)
    per_cluster = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("c"), F.count_if(r == 1).alias("p"), F.count_if(r == 0).alias("n"))
    return per_cluster.groupBy(*by).agg(
        F.sum("c").alias("records"), F.count(cluster).alias("clusters"), F.sum("p").alias("reading_positive_records"), F.sum("n").alias("reading_negative_records"),
        F.count_if(F.col("p") > 0).alias("reading_positive_clusters"), F.count_if(F.col("n") > 0).alias("reading_negative_clusters"))


def variable_descriptors(df: DataFrame, by: Sequence[str], variables: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """Per cohort and variable: observed and missing records and clusters, mean and exact median."""
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = df.select(*by, cluster, F.inline(rows))
    keys = [*by, "variable"]
    per_cluster = long.groupBy(*keys, cluster).agg(F.count("value").alias("o"), F.count_if(F.col("value").isNull()).alias("m"), F.sum("value").alias("s"))
    described = per_cluster.groupBy(*keys).agg(
        F.sum("o").alias("observed_records"), F.count_if(F.col("o") > 0).alias("observed_clusters"),
        F.sum("m").alias("missing_records"), F.count_if(F.col("m") > 0).alias("missing_clusters"), ratio(F.sum("s"), F.sum("o")).alias("mean"))
    return null_safe_join(described, exact_quantiles(long, keys, "value", [0.5], ["median"]), keys, "left")


def reading_outcome_cells(df: DataFrame, by: Sequence[str], reading: str, outcome: str, cluster: str = "cluster_id") -> DataFrame:
    """The 2 x 2 cells with records and distinct clusters; empty cells are kept."""
    per_cluster = df.groupBy(*by, F.col(reading).alias("reading_positive"), F.col(outcome).alias("outcome_positive"), cluster).agg(F.count(F.lit(1)).alias("c"))
    counts = per_cluster.groupBy(*by, "reading_positive", "outcome_positive").agg(F.sum("c").alias("records"), F.count(cluster).alias("clusters"))
    grid = M.full_grid(counts, by, {"reading_positive": [0, 1], "outcome_positive": [0, 1]})
    return null_safe_join(grid, counts, [*by, "reading_positive", "outcome_positive"], "left").fillna(0, ["records", "clusters"])


def cross_table(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    pick = lambda o: F.sum(F.when(F.col("outcome_positive") == o, F.col("records")).otherwise(0)).alias(f"outcome_{o}")
    return cells.groupBy(*by, "reading_positive").agg(pick(0), pick(1))


def reading_rates(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outcome rate per reading with its denominator; an absent group is NULL, not 0."""
    summed = cells.groupBy(*by, "reading_positive").agg(
        F.sum("records").alias("total"), F.sum(F.when(F.col("outcome_positive") == 1, F.col("records")).otherwise(0)).alias("positive"))
    return summed.withColumn("rate", ratio(F.col("positive"), F.col("total")))


def min_group_gate(df: DataFrame, by: Sequence[str], target: str, k: int, cluster: str = "cluster_id") -> DataFrame:
    """Whether both classes have max(6, 2k) clusters; otherwise only a status is reported."""
    need = max(6, 2 * k)
    counts = M.cohort_counts(df, by, target, cluster)
    ok = (F.col("positive_clusters") >= need) & (F.col("negative_clusters") >= need)
    return counts.select(*by, "positive_clusters", "negative_clusters", F.lit(need).cast("bigint").alias("min_groups"),
                         F.when(ok, "ok").otherwise("insufficient_outcome_groups").alias("status"))


def fraction_auroc(df: DataFrame, by: Sequence[str], fraction: str, outcome: str) -> DataFrame:
    """The abnormal fraction taken as a score for the outcome."""
    return M.auroc(df.where(F.col(fraction).isNotNull() & F.col(outcome).isNotNull()), by, fraction, outcome)


def annotation_agreement(records: DataFrame, segments: DataFrame, mapping: Sequence[tuple[str, str, str]], record: str = "record_id", minimum: int = 5) -> DataFrame:
    """Record labels against aggregated segment features.

    mapping rows: (label, feature, kind); continuous and ordinal features are
    averaged over a record, counts are summed. All mapping rows share one plan.
    Averages are taken to 9 decimals, so that equal ones tie whatever the order of summation.
    """
    means = {f for _, f, kind in mapping if kind in ("continuous", "ordinal")}
    rolled = segments.groupBy(record).agg(*[(F.round(F.avg(f), 9) if f in means else F.sum(f)).cast("double").alias("_f_" + f) for f in sorted({f for _, f, _ in mapping})])
    wide = records.join(rolled, record)
    rows = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(f).alias("feature"), F.lit(kind).alias("kind"), F.col(l).cast("double").alias("y"), F.col("_f_" + f).alias("x")) for l, f, kind in mapping])
    long = materialize(wide.select(F.inline(rows)).where(F.col("x").isNotNull() & F.col("y").isNotNull()), "agreement")
    keys = ["label", "feature", "kind"]
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("_lx"), F.max("x").alias("_hx"), F.min("y").alias("_ly"), F.max("y").alias("_hy"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("_mae"))
    rho = M.spearman(long, keys, "x", "y").drop("n")
    positive = F.when(F.col("kind") == "acceleration", (F.col("y") == 1).cast("int")).otherwise((F.col("y") > 0).cast("int"))
    area = M.auroc(long.where(F.col("kind").isin("acceleration", "binary")).withColumn("_p", positive), keys, "x", "_p")
    joined = base.join(rho, keys, "left").join(area, keys, "left")
    ok = (F.col("n") >= minimum) & (F.col("_lx") < F.col("_hx")) & (F.col("_ly") < F.col("_hy"))
    return joined.select(*keys, "n", F.when(ok, "ok").otherwise("constant_or_insufficient").alias("status"), F.when(ok, F.col("spearman")).alias("spearman"),
                         F.when(ok & (F.col("kind") == "continuous"), F.col("_mae")).alias("mae"), F.when(ok, F.col("auroc")).alias("auroc"))
