"""Leakage-free splits: every decision is made per cluster and projected to rows.

Order within a stratum comes from md5(seed|cluster), so assignments are
deterministic, portable, and balanced over strata.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import keyed_md5
from ..plans.ordering import digest_index
from ..sources.scratch import materialize


def cluster_strata(df: DataFrame, cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    """One row per cluster with its stratum. Written once: numbering reads it several times."""
    return materialize(df.groupBy(cluster).agg(F.max(target).alias("stratum")), "strata")


def numbered(strata: DataFrame, seed: int, cluster: str, within: Sequence[str] = (), salt: Sequence[str] = ()) -> DataFrame:
    """Adds each cluster's position in its stratum, in the order of md5(seed|cluster)."""
    hashed = strata.withColumn("_digest", keyed_md5(seed, *[F.col(c) for c in (*salt, cluster)]))
    return digest_index(hashed, [*within, "stratum"], "_digest", "_position").drop("_digest")


def group_folds(df: DataFrame, k: int, seed: int, cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    """One row per cluster: stratum and fold in 0..k-1. Positives are spread evenly over folds."""
    placed = numbered(cluster_strata(df, cluster, target), seed, cluster)
    return placed.select(cluster, "stratum", (F.col("_position") % k).cast("int").alias("fold"))


def assign(df: DataFrame, assignment: DataFrame, cluster: str = "cluster_id", how: str = "inner") -> DataFrame:
    """Projects a cluster-level assignment to rows."""
    return df.join(assignment, cluster, how)


def holdout_split(df: DataFrame, seed: int = 42, test_folds: int = 10, validation_folds: int = 9,
                  cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    """About 80/10/10: the first outer fold is test, the first inner fold of the rest is validation."""
    outer = group_folds(df, test_folds, seed, cluster, target)
    inner = numbered(outer.where(F.col("fold") != 0).drop("fold"), seed + 1, cluster)
    rest = inner.select(cluster, F.when(F.col("_position") % validation_folds == 0, "val").otherwise("train").alias("split"))
    return outer.where(F.col("fold") == 0).select(cluster, F.lit("test").alias("split")).unionByName(rest)


class TooFewClusters(ValueError):
    """A split cannot be formed from the clusters available."""


def fold_capacity(df: DataFrame, k: int, cluster: str = "cluster_id") -> DataFrame:
    return df.select(cluster).distinct().agg(F.count(F.lit(1)).alias("clusters")).select(
        "clusters", F.lit(k).cast("bigint").alias("required"), F.when(F.col("clusters") >= k, "ok").otherwise("too_few_clusters").alias("status"))


def require_clusters(df: DataFrame, k: int, cluster: str = "cluster_id") -> None:
    """Raises when fewer than k clusters exist; the check stops at the k-th."""
    found = df.select(cluster).distinct().limit(k).count()
    if found < k:
        raise TooFewClusters(f"need at least {k} clusters, found {found}")


def flag_member(df: DataFrame, members: DataFrame, column: str = "cluster_id", name: str = "prior_seen") -> DataFrame:
    """Marks rows whose id is in the member list."""
    ids = members.select(F.col(column).alias("_member")).distinct()
    return df.join(ids, F.col(column) == F.col("_member"), "left").withColumn(name, F.col("_member").isNotNull()).drop("_member")


def split_with_prior(df: DataFrame, prior: DataFrame, seed: int = 42, test_folds: int = 10, validation_folds: int = 9,
                     cluster: str = "cluster_id", target: str = "target", check: bool = True) -> DataFrame:
    """Clusters seen before stay in training; only fresh ones can be validation or test."""
    known = prior.select(cluster).distinct()
    fresh = df.join(known, cluster, "left_anti")
    if check:
        require_clusters(fresh, max(test_folds, validation_folds + 1), cluster)
    seen = df.join(known, cluster, "left_semi").select(cluster).distinct()
    return (holdout_split(fresh, seed, test_folds, validation_folds, cluster, target).withColumn("prior_seen", F.lit(False))
            .unionByName(seen.select(cluster, F.lit("train").alias("split"), F.lit(True).alias("prior_seen"))))


def nested_folds(df: DataFrame, k: int, inner: int, seed: int, cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    """One row per (outer fold, cluster) with its role: hold, tune or fit.

    The training pool of each outer fold is split again; its first inner fold
    tunes. The copy count is the fold count.
    """
    outer = group_folds(df, k, seed, cluster, target)
    copies = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    hold = copies.where(F.col("outer_fold") == F.col("fold")).select("outer_fold", cluster, F.lit("hold").alias("role"))
    pool = copies.where(F.col("outer_fold") != F.col("fold")).drop("fold")
    placed = numbered(pool, seed, cluster, ["outer_fold"], ["outer_fold"])
    roles = placed.select("outer_fold", cluster, F.when(F.col("_position") % inner == 0, "tune").otherwise("fit").alias("role"))
    return hold.unionByName(roles)


def loso_plan(df: DataFrame, site: str = "site", cluster: str = "cluster_id", target: str = "target", min_clusters: int = 8) -> DataFrame:
    """Per held site: its rows, and what is left after removing all its clusters everywhere.

    The remainder is total minus the held clusters, so no site is paired with every row.
    """
    per_pair = df.groupBy(site, cluster).agg(F.count(F.lit(1)).alias("rows"), F.sum(target).alias("pos"))
    held = per_pair.groupBy(site).agg(F.sum("rows").alias("held_rows"), F.sum("pos").alias("held_positives"), F.count(F.lit(1)).alias("held_clusters"))
    per_cluster = per_pair.groupBy(cluster).agg(F.sum("rows").alias("all_rows"), F.sum("pos").alias("all_pos"))
    removed = per_pair.select(site, cluster).join(per_cluster, cluster).groupBy(site).agg(
        F.sum("all_rows").alias("removed_rows"), F.sum("all_pos").alias("removed_positives"))
    total = per_cluster.agg(F.sum("all_rows").alias("_rows"), F.sum("all_pos").alias("_pos"), F.count(F.lit(1)).alias("_clusters"))
    whole = lambda c: total.select(c).scalar()
    plan = held.join(removed, site).select(
        site, "held_rows", "held_clusters", "held_positives",
        (whole("_rows") - F.col("removed_rows")).alias("development_rows"),
        (whole("_clusters") - F.col("held_clusters")).alias("development_clusters"),
        (whole("_pos") - F.col("removed_positives")).alias("development_positives"))
    mixed = lambda rows, pos: (F.col(pos) > 0) & (F.col(pos) < F.col(rows))
    ready = mixed("held_rows", "held_positives") & mixed("development_rows", "development_positives") & (F.col("development_clusters") >= min_clusters)
    return plan.withColumn("status", F.when(ready, "ok").otherwise("insufficient_classes_or_groups"))


def split_summary(df: DataFrame, by: str = "split", record: str = "record_id", cluster: str = "cluster_id", target: str = "target") -> DataFrame:
    per_record = df.groupBy(by, cluster, record).agg(F.count(F.lit(1)).alias("segments"), F.sum(target).alias("pos"))
    per_cluster = per_record.groupBy(by, cluster).agg(F.count(F.lit(1)).alias("records"), F.sum("segments").alias("segments"), F.sum("pos").alias("pos"))
    return per_cluster.groupBy(by).agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("clusters"),
                                       F.sum("segments").alias("segments"), F.sum("pos").alias("positives"))


def leakage(df: DataFrame, by: str = "split", cluster: str = "cluster_id") -> DataFrame:
    """Clusters found in more than one split or fold; empty when there is no leakage."""
    return df.groupBy(cluster, by).count().groupBy(cluster).agg(F.count(F.lit(1)).alias("n_splits")).where(F.col("n_splits") > 1)


def cohort_history(assignment: DataFrame, prior: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """How many prior clusters were supplied, found, and where they ended up."""
    supplied = prior.select(cluster).distinct()
    joined = supplied.join(assignment.select(cluster, "split").distinct(), cluster, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("supplied_clusters"), F.count("split").alias("matched_clusters"),
        F.count_if(F.col("split") == "val").alias("matched_validation_clusters"),
        F.count_if(F.col("split") == "test").alias("matched_test_clusters"))


def sample_n(df: DataFrame, k: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """A reproducible sample of min(rows, k): the k smallest digests (a distributed top-k)."""
    return df.withColumn("_digest", keyed_md5(seed, *[F.col(c) for c in keys])).orderBy("_digest").limit(k).drop("_digest")


def require_two_classes(df: DataFrame, by: Sequence[str], target: str = "target") -> DataFrame:
    return df.groupBy(*by).agg(F.min(target).alias("lowest"), F.max(target).alias("highest")).select(
        *by, F.when((F.col("lowest") == 0) & (F.col("highest") == 1), "ok").otherwise("insufficient_classes").alias("status"))
