"""One query for each corpus operator, over its whole table and with production parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import boosted_quality, byte_bpe, decontamination, hard_negatives, html_blocks, katz, lexical_nra, line_chunks, packing, quality_rules, simhash_ball, suffix_dedup, token_counts
from .registry import CHECKS, QUERIES, query  # noqa: F401
from .tables import read


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    scored = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "probability")


@query("op9_simhash_ball")
def op9_simhash_ball(spark, sf_dir):
    classes = simhash_ball.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_genetic_packing")
def op4_genetic_packing(spark, sf_dir):
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), ["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_line_chunks", line_chunks.ORACLE_SQL)
def op7_line_chunks(spark, sf_dir):
    kept = line_chunks.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5("text").alias("kept_md5"))


@query("op1_spaced_seeds", decontamination.ORACLE_SQL)
def op1_spaced_seeds(spark, sf_dir):
    found = decontamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "doc_start", "item_start", "n_tokens", "n_equal")


@query("op5_boosted_quality")
def op5_boosted_quality(spark, sf_dir):
    return boosted_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_html_blocks")
def op6_html_blocks(spark, sf_dir):
    return html_blocks.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])


@query("op2_deep_shallow")
def op2_deep_shallow(spark, sf_dir):
    return suffix_dedup.dedup_stretches(read(spark, sf_dir, "documents"), ["doc_id"])


@query("op3_katz_backoff")
def op3_katz_backoff(spark, sf_dir):
    return katz.score(read(spark, sf_dir, "documents"), pooled=True)


@query("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), path, ["doc_id"])
    decoded = byte_bpe.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_lexical_nra", lexical_nra.ORACLE_SQL)
def op12_lexical_nra(spark, sf_dir):
    return lexical_nra.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", hard_negatives.ORACLE_SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(relabelled, F.col("vec_id") % 100 == 0)
