"""The pipeline of text operators over documents: each stage works on what the one before it kept.

Stages take and return the columns of documents, but for the last, which gives digests of the encoded texts. n_chars
follows the text where a stage changes it. Repeated rows of one doc_id and text are one document's rows and stay or go
together. Extra columns of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm import decontaminate, language, minhash, pieces, repeats
from sourceweave.llm.common import stash, table
from sourceweave.llm.queries import tokenizer

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share this many hundredths of their shingles or more.
SIMILAR = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go. If no row has a language to learn from, all stay."""
    docs = docs.select(*DOCUMENTS)
    model = language.learn(docs)
    if not model.langs:
        return docs
    return language.predict(docs, model).where(F.col("lang_pred") != language.UND).select(*DOCUMENTS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    docs = docs.select(*DOCUMENTS)
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), SIMILAR).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row")).distinct()
    own = docs.withColumn("row_", F.xxhash64("text"))
    return own.join(kept, (F.col("row_") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*DOCUMENTS)


def _with_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of 50 words that also stand elsewhere are cut from every text; the documents stay."""
    return _with_chars(repeats.clean(docs.select(*DOCUMENTS)))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter matches are cut from the others."""
    return _with_chars(decontaminate.clean(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark", "item_id", "text")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each text and of the text they decode to."""
    return pieces.report(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("benchmark", benchmark_stage),
    ("sentencepiece", encode_stage),
]
#: Several stages are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *DOCUMENTS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
