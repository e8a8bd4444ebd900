"""Descriptive profiles of source tables: no repair, no imputation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import as_double, finite

# Fixed value: the text form of the sentinel counted in profiles.
SENTINEL_TEXT = "9999"


def inventory(df: DataFrame, kind: str = "kind", size: Column | None = None, parsed: Column | None = None) -> DataFrame:
    size = F.octet_length("payload") if size is None else size
    parsed = F.lit(True) if parsed is None else parsed
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("files"), F.sum(size.cast("bigint")).alias("bytes"), F.count_if(parsed).alias("parsed"))


def profile_fields(df: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Per (kind, field) of JSON objects: presence, type counts, blanks, sentinels, zeros.

    The denominator is the number of parsed objects of that kind, so a field's
    absence is counted and not lost.
    """
    objects = df.select(kind, F.try_parse_json(payload).alias("_v")).where(F.col("_v").isNotNull())
    totals = objects.groupBy(kind).agg(F.count(F.lit(1)).alias("parsed_denominator"))
    fields = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(kind, F.col("key").alias("field"), "value")
    of = F.schema_of_variant("value")
    text = F.trim(F.try_variant_get("value", "$", "string"))
    typed = lambda *names: F.count_if(of.isin(*names))
    number = F.try_variant_get("value", "$", "double")
    counted = fields.groupBy(kind, "field").agg(
        F.count(F.lit(1)).alias("present"), typed("STRING").alias("type_string"), typed("BIGINT").alias("type_int"),
        F.count_if(of.startswith("DECIMAL") | of.isin("DOUBLE", "FLOAT")).alias("type_float"), typed("BOOLEAN").alias("type_bool"),
        F.count_if(of.startswith("ARRAY")).alias("type_array"), F.count_if(of.startswith("OBJECT")).alias("type_object"),
        F.count_if((of == "VOID") | (F.coalesce(text, F.lit("x")) == "")).alias("null_or_blank"),
        F.count_if(F.coalesce(text, F.lit("")) == SENTINEL_TEXT).alias("sentinel_9999"),
        F.count_if(F.coalesce(number == 0, F.lit(False)) & ((of != "STRING") | (text == "0"))).alias("zero"))
    return counted.join(totals, kind).withColumn("absent", F.col("parsed_denominator") - F.col("present"))


def shape_variants(df: DataFrame, keys: Sequence[str] = ("interval", "x_samples", "y_samples", "x_type", "y_type")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))


def signal_stats(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Per window of comma-separated samples: counts, extremes, longest zero and flat runs; nothing imputed."""
    parts = df.select(*keys, F.posexplode(F.split(text, ",")).alias("_pos", "_token"))
    value = as_double(F.trim("_token"))
    read = parts.select(*keys, "_pos", F.when(finite(value), value).alias("_v"))
    ordered = Window.partitionBy(*keys).orderBy("_pos")
    usable = F.coalesce(F.col("_v") != 0, F.lit(False))
    same = usable & F.coalesce(F.col("_v") == F.lag("_v").over(ordered), F.lit(False))
    marked = read.select("*", usable.alias("_usable"), same.alias("_same"), F.coalesce(F.col("_v") == 0, F.lit(False)).alias("_zero"))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.select("*", F.sum((~F.col("_zero")).cast("int")).over(running).alias("_zrun"), F.sum((~F.col("_same")).cast("int")).over(running).alias("_frun"))
    # Longest runs: the running count within each run, maximised in the same pass.
    zlen = F.count_if("_zero").over(Window.partitionBy(*keys, "_zrun").orderBy("_pos"))
    flen = F.count_if("_usable").over(Window.partitionBy(*keys, "_frun").orderBy("_pos"))
    lengths = numbered.select("*", zlen.alias("_zlen")).select("*", flen.alias("_flen"))
    return lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("_v").isNull()).alias("invalid"), F.count_if("_zero").alias("zeros"),
        F.count_if(F.col("_v") < 0).alias("negative"), F.max("_zlen").alias("longest_zero"), F.max("_flen").alias("longest_flat"),
        F.min("_v").alias("minimum"), F.max("_v").alias("maximum"))


def contract_flag(df: DataFrame, dt: float, samples: int, interval: str = "interval") -> DataFrame:
    """Candidate for the agreed shape: right interval, full valid channels, no negative primary value."""
    full = (F.col("x_samples") == samples) & (F.col("y_samples") == samples) & (F.col("x_invalid") == 0) & (F.col("y_invalid") == 0)
    ok = F.coalesce((F.col(interval) == dt) & full & (F.col("x_negative") == 0), F.lit(False))
    return df.withColumn("contract_candidate", ok).withColumn("equal_lengths", F.col("x_samples") == F.col("y_samples"))


def site_quality(df: DataFrame, site: str = "site") -> DataFrame:
    return df.groupBy(site).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("contract_candidate").alias("contract_candidates"),
        *[F.sum(f"{c}_{m}").alias(f"{c}_{m}") for c in ("x", "y") for m in ("samples", "zeros", "invalid", "negative")])


def fingerprint(*columns: str) -> Column:
    return F.sha2(columns[0] if len(columns) == 1 else F.to_json(F.struct(*columns)), 256)


def duplicate_groups(df: DataFrame, id_column: str, payload: Sequence[str]) -> DataFrame:
    """Groups of distinct ids with an identical payload: size and first id per fingerprint."""
    pairs = df.select(fingerprint(*payload).alias("fingerprint"), F.col(id_column).alias("id")).distinct()
    return pairs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("distinct_ids"), F.min("id").alias("first_id")).where(F.col("distinct_ids") > 1)


def duplicate_members(df: DataFrame, id_column: str, payload: Sequence[str]) -> DataFrame:
    """The members of those groups, one row each, so that no group is gathered into a list."""
    pairs = df.select(fingerprint(*payload).alias("fingerprint"), F.col(id_column).alias("id")).distinct()
    groups = pairs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("distinct_ids")).where(F.col("distinct_ids") > 1)
    return pairs.join(groups, "fingerprint")


def duplicate_ids(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Ids found in more than one file, one row per file."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > 1)
    return df.select(*keys, path).join(counted, list(keys))


def linkage(a: DataFrame, l: DataFrame, e: DataFrame, key: str) -> DataFrame:
    """Funnel of distinct keys over three sources, in one pass over their union."""
    marks = ("in_a", "in_l", "in_e")
    parts = [df.select(F.col(key).alias("_key"), *[F.lit(m == mark).alias(m) for m in marks]) for df, mark in ((a, "in_a"), (l, "in_l"), (e, "in_e"))]
    keys = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("_key").agg(*[F.max(m).alias(m) for m in marks])
    A, L, E = (F.col(m) for m in marks)
    return keys.agg(*[F.count_if(c).alias(n) for n, c in (
        ("a_ids", A), ("a_with_l", A & L), ("a_with_l_and_e", A & L & E), ("a_without_l", A & ~L), ("a_without_e", A & ~E), ("l_without_a", L & ~A), ("e_without_a", E & ~A))])


def dedup_with_conflicts(df: DataFrame, id_column: str, content: str, fill: str) -> DataFrame:
    """One row per id: identical copies collapse, different content conflicts.

    The fill value may be missing in some copies and is taken from the others;
    two different values conflict.
    """
    return df.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("copies"), F.min(content).alias("_lo"), F.max(content).alias("_hi"),
        F.min(fill).alias("_flo"), F.max(fill).alias("_fhi")).select(
        id_column, "copies", F.col("_flo").alias(fill),
        F.when((F.col("_lo") != F.col("_hi")) | (F.col("_flo") != F.col("_fhi")), "conflict")
        .when(F.col("copies") > 1, "deduplicated").otherwise("single").alias("status"))
