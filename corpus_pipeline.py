"""From documents to packed training sequences: five stages, each a call of one operator.

Every stage but the last returns the columns of documents. Language ID drops documents without a language; the n-gram
Jaccard join keeps one document of each group of near duplicates (five words, similarity 0.8); substring dedup takes
passages of 13 words or more out of all documents but the first that has them, and drops documents of which nothing is
left; mixing repeats, keeps, cuts or leaves out documents so that each source comes to its share; packing lays what is
left into sequences of 4,096 tokens.

A stage's result is written by whoever called it, so stages that end in Python set the size of its batches for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import jaccard, langid, mixing, packing, substrings
from latticework.llm.common import documents, materialize
from latticework.llm.queries import tokenizer_path
from latticework.plans.scratch import SMALL_BATCHES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """docs in the columns of documents, n_chars being that of the text now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _small_batches(spark: SparkSession) -> None:
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    return langid.identify(docs).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    cleaned = substrings.dedup_substrings(docs.select(*COLUMNS))
    return _columns(cleaned.where("n_removed < n_words OR n_words = 0"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    sized = materialize(docs.select("doc_id", "source", mixing.word_count().alias("size")), "sizes")
    return _columns(mixing.take_words(mixing.mix_sources(docs, sized), COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]

#: The learned references and the tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
