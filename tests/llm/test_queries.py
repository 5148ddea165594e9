"""The registered queries: their columns over the smallest tables, and their SQL where there is some."""

import os

import duckdb
import pytest

from quarrygraph.llm import queries

COLUMNS = {
    "op1_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_chat_formatting": {"thread_id": "bigint", "conv_id": "bigint", "turn": "bigint", "formatted": "string"},
    "op6_mixing": {"doc_id": "bigint", "source": "string", "n_copies": "bigint"},
    "op7_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_phrase_mining": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}
TABLE = {"op4_embedding_dedup": "embeddings", "op5_chat_formatting": "conversations", "op7_warc": "pages"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    if name in ("op11_phrase_mining", "op12_spelling"):  # not one row a document
        assert got.count() > 0
        return
    assert got.count() == spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
