"""The queries of the text operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, language, license, minhash, pieces, repeats, sql, tokens, urls
from .common import shared_folder, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.report(decontaminate.contaminated_spans(docs, bench))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), out)
    return tokens.report(tokens.read_tokens(spark, out))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.report(license.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("row")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
