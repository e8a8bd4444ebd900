"""Views that bind the operators to the star-schema tables.

samples      one row per signal sample, keyed (record_id, seg_idx, sample_idx)
segments     one row per 10-sample segment
predictions  scored units of two models, keyed (record_id, seg_idx)
records      one row per order with its covariates and outcome column
documents    one row per document with its optional labels
raw_files    heterogeneous text sources with kind and size
journal      timestamped events of a run

Groups are never assumed small: positions come from ``ordered_index``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ordering import ordered_index, spread_large

# Fixed values of the binding: samples per segment, and the sampling rate in Hz it implies (100 s windows).
SEGMENT_SAMPLES = 10
SAMPLE_RATE = 0.1
SEGMENT = ["record_id", "seg_idx"]


# Column types of the source tables; a declared schema saves the inference job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the line items, a large table dealt by order; the row count comes from the file footers."""
    lines = table(spark, sf_dir, "lineitem")
    return spread_large(lines.select(*columns), lines.count(), "l_orderkey")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    placed = ordered_index(events, ["user_id"], ["ts", "event_id"], "i", memo=(sf_dir, "events", "user_id"))
    return placed.select(
        F.col("user_id").alias("record_id"),
        F.expr("user_id div 2").alias("cluster_id"),
        F.expr("cast(user_id % 12 as int)").alias("site"),
        F.expr(f"i div {SEGMENT_SAMPLES}").alias("seg_idx"),
        F.expr(f"i % {SEGMENT_SAMPLES}").alias("sample_idx"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("x"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("y"),
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("record_id", "cluster_id", "site", "seg_idx").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("event_type") == "purchase") >= 3).cast("int").alias("target"),
        (F.avg("y") / 100).alias("score"),
        F.avg((F.col("x") == 0).cast("double")).alias("missing_fraction"),
        F.avg("x").alias("x_mean"),
        F.max("x").alias("x_max"),
        F.avg("y").alias("y_mean"),
        F.count_if(F.col("x") > 100).cast("double").alias("n_high"),
    )


SEGMENT_FEATURES = ["x_mean", "x_max", "y_mean", "n_high", "missing_fraction"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide form: one row per scored unit with the scores of both models."""
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = line_items(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate",
                       "l_returnflag", "l_quantity", "l_discount")
    placed = ordered_index(lines, ["l_orderkey"],
                           ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"],
                           "seg_idx", memo=(sf_dir, "lineitem", "l_orderkey"))
    return placed.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("record_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.col("c_nationkey").alias("site"),
        "seg_idx",
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        (F.col("l_quantity") / 50).alias("m1"),
        (F.col("l_discount") * 10).alias("m2"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without positions, for work that only groups; saves the ordering step."""
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = line_items(spark, sf_dir, "l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("record_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.col("c_nationkey").alias("site"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        (F.col("l_quantity") / 50).alias("m1"),
        (F.col("l_discount") * 10).alias("m2"),
    )


def by_model(wide: DataFrame, models: tuple[str, ...] = ("m1", "m2")) -> DataFrame:
    """Long form: one row per (unit, model) with its score."""
    keep = [c for c in wide.columns if c not in models]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    return wide.select(*keep, F.inline(pairs))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_items(spark, sf_dir, "l_orderkey", "l_returnflag").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("target"))
    rollup = lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.max("target").alias("any_abnormal"),
        F.avg(F.col("target").cast("double")).alias("abnormal_fraction"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return (orders.join(owners, F.col("o_custkey") == F.col("c_custkey"))
            .join(rollup, F.col("o_orderkey") == F.col("record_id"), "left")
            .select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("cluster_id"),
                    F.col("c_nationkey").alias("site"), "any_abnormal", "abnormal_fraction", "n_segments",
                    F.col("c_acctbal").alias("balance"), F.col("o_totalprice").alias("price"),
                    F.col("o_orderdate").cast("timestamp").alias("order_date"), F.col("o_orderpriority").alias("priority"),
                    F.col("o_orderstatus").alias("status_code")))


def doc_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "left").select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("cluster_id"), F.col("lang").alias("site"),
        "quality", "toxic", "n_chars", "label_id")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("kind"), F.col("text").alias("payload"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("kind"), F.col("html").alias("payload"))
    talks = table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.lit("conversations").alias("kind"), F.col("text").alias("payload"))
    return docs.unionByName(pages).unionByName(talks)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("run"),
        F.col("event_type").alias("event"), F.col("value").alias("metric"), "event_id", "props")
