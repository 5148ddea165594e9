import hashlib

import pytest
from tokenizers import Tokenizer

from quarrygraph.llm import bpe, token_counts
from quarrygraph.llm.queries import vocabulary

ODD = [
    None, "", "a<|endoftext|>b <|startoftext|> x", "ΣΑΣ İstanbul ς", "日本語 テキスト ½ ² é Å", "x" * 3000 + " " * 300 + "\n\n\t1234567",
    "I'll don't DON'T ''s !'s 'll", "͸՘ \U0001f600 \x1c\x1d a", "   x　y", "<|endoftext|><|endoftext|", "é Å", "12 345,678.9 ٣",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again")], "doc_id long, text string")
    return table.unionByName(odd)


def counted(rows):
    return sorted(rows, key=str)


def test_bpe_digests_match_the_library(docs):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert counted(map(tuple, bpe.encode_digests(docs, vocabulary("byte_bpe_50k.json")).collect())) == counted(want)


def test_bpe_ids_and_decoding(docs):
    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    encoded = bpe.encode_documents(docs, path)
    want = counted((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert counted((r.doc_id, r.ids) for r in encoded.collect()) == want
    assert counted((r.doc_id, r.text) for r in bpe.decode_documents(encoded, path).collect()) == counted((r.doc_id, r.text or "") for r in docs.collect())
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_merging_a_long_piece():
    b = bpe.ByteBpe(vocabulary("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(b.path)
    for text in ("a" * 20_000, "thetheintionthe" * 900, "é" * 5000, "\x00\xff" * 700):
        assert b.encode(text) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [500, 32 << 20])
def test_token_counts_match_the_library(docs, block):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    got = token_counts.token_counts(docs, vocabulary("word_bpe_49k.json"), block_bytes=block)
    assert counted(map(tuple, got.collect())) == counted(want)
    assert token_counts.token_counts(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
