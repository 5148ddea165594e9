"""From raw documents to token ids in five stages, each an operator of ``quarrygraph.llm`` with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import bpe, mixing, pii, quality, simhash
from quarrygraph.llm.common import read_table, write_shared
from quarrygraph.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go."""
    return quality.keep_good(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are generalised in the texts; every document stays. The length
    column, where there is one, follows the text."""
    out = pii.sanitise(docs)
    return out.selectExpr(*[f"cast(length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c, kind in out.dtypes])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight gives it."""
    return mixing.realise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, name)
    return docs


#: The fitted classifier of the first stage has no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None
