"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

Every function takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of
documents. Rejected documents, leaked documents and all but one document of each
near-duplicate class go; repeated passages are cut out of the texts that stay; the last stage gives
one row for each packed piece. Each stage is judged on what its predecessor kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from segstat.llm import decontamination, line_chunks, packing, quality_rules, simhash_ball
from segstat.llm.queries import tokenizer_path
from segstat.llm.tables import materialize, read


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier; labels of other documents play no part."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = quality_rules.quality_rules(packed, read(spark, sf_dir, "labels"), keep=["_row"])
    return scored.where("kept").select("_row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of several lines that stand in an earlier place."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = line_chunks.dedup_lines(packed)
    changed = F.col("n_removed_chunks") > 0
    columns = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        if c == "text":
            old = F.when(changed, F.col("text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return kept.select(*columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; rows without an id stay."""
    classes = materialize(simhash_ball.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(classes.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark passage."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of at most 4096 tokens."""
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), ["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", drop_low_quality), ("line_dedup", cut_repeated_lines), ("near_duplicates", one_of_each_class),
          ("decontamination", drop_leaks), ("packing", pack_sequences)]

# XXH64 fingerprints, the fitted classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
