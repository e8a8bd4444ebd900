"""Connected components of a distributed edge list by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import materialize

MAX_ROUNDS = 60   # each round about halves the depth of every tree, so this is never reached


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each half round groups the neighbours of a node by a combinable minimum and relinks them to
    it; all links stay in written tables. Loops and rows with a missing end are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    state = _digest(links)
    for _ in range(MAX_ROUNDS):
        links = materialize(_small(_large(links)), "links")
        before, state = state, _digest(links)
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")) \
                .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.expr("xxhash64(a, b) div 65536"))).first())


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a > b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a > b")
    return moved.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()
