"""The registered queries of this subpackage: each applies one operator, with production settings, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, audit, conversations, fingerprints, jaccard, langid, mixing, oddsketch, packing, quality, substrings, toxicity, wrappers
from .common import documents, held_out, materialize
from .sql import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return langid.identify(rows, langid.references(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", mixing.word_count().alias("size")), "sizes")
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return wrappers.extract_pages(pages).select("page_id", "url", "text", "n_chars")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, boundary-crossing tokens going to the line that holds most of them."""
    import public_tokenizers

    return attribution.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substrings.dedup_substrings(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_near(documents(spark, sf_dir).select("doc_id", "text"), length=3, percent=90)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), length=3, percent=85)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
