"""Sources and sinks: file scans, tolerant JSON, typed tables, manifests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scan_sources(spark: SparkSession, root: str, kinds: Sequence[str]) -> DataFrame:
    """Every file below a root with its kind, size and time; contents are not read.

    A JSON file's kind is the name of its folder; anything else is 'other:<suffix>'.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    parent = F.regexp_replace(F.element_at(F.split("path", "/"), -2), r"^kind=", "")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when((suffix == ".json") & parent.isin(*kinds), parent).otherwise(F.concat(F.lit("other:"), suffix))
    return files.select("path", kind.alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_json_tolerant(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse as a JSON object, and the others with a reason; neither stops the job."""
    declared = T.StructType.fromDDL(schema).add("_corrupt", "string")
    parsed = df.withColumn("_parsed", F.from_json(column, declared, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    is_object = F.col(column).rlike(r"^\s*\{")
    bad = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull() | ~F.coalesce(is_object, F.lit(False))
    fields = [f.name for f in declared.fields if f.name != "_corrupt"]
    good = parsed.where(~bad).select(*df.columns, *[F.col("_parsed." + f).alias(f) for f in fields])
    issues = parsed.where(bad).select(*df.columns, F.when(F.coalesce(is_object, F.lit(False)), "unreadable_json").otherwise("not_an_object").alias("category"))
    return good, issues


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv", ids: Sequence[str] = ("record_id", "cluster_id", "site")) -> DataFrame:
    """A typed table whose identifiers are text, whatever they look like."""
    declared = T.StructType.fromDDL(schema)
    forced = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids and fmt != "parquet" else f.dataType, True) for f in declared.fields])
    reader = spark.read.schema(forced)
    table = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return table.select(*[F.col(f.name).cast("string").alias(f.name) if f.name in ids else F.col(f.name) for f in declared.fields])


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per table; never overwrites. An empty result keeps its typed schema."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        (writer.option("header", "true").csv if fmt == "csv" else writer.format(fmt).save)(f"{folder}/{name}")


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    return df.select(F.col(name).alias("name"), F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"))


def manifest_of_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace("path", r"^.*/" + folder.rstrip("/").split("/")[-1] + "/", "")
    return files.select(relative.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_manifest(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Names whose content changed, disappeared or was added; empty when everything matches."""
    a = recorded.select("name", F.col("sha256").alias("recorded"))
    b = found.select("name", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.col("recorded") != F.col("found"), "changed")
    return a.join(b, "name", "full").select("name", state.alias("state")).where(F.col("state").isNotNull())
