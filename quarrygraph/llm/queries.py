"""The operators' queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embedding_dedup, licenses, mixing, phrases, pii, quality, simhash, spelling, suffix_dedup, token_counts, warc
from .common import read_table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: under ``QUARRY_TOKENIZERS`` where set, else the installed package's."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.read_archive(*warc.write_archive(read_table(spark, sf_dir, "pages"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(licenses.find_licenses(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_spelling": op12_spelling,
    "op13_licenses": op13_licenses,
}
ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op7_warc": warc.ORACLE,
    "op11_phrase_mining": phrases.ORACLE,
}
