import hashlib
import random

import pytest

from quarrygraph.llm import suffix_dedup


def brute(rows, length=50):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t in order:
        b = (t or "").encode()
        i = 1 << 63 if i is None else i
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w not in first or first[w] > i:
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (1 << 63 if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


@pytest.mark.parametrize("block", [3_000, 4 << 20])
def test_test_documents(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(docs, block_bytes=block) == brute([tuple(r) for r in docs.collect()])


def test_odd_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    base = word(400)
    rows = [(7, base), (3, base[100:300]), (9, base[:120] + word(10) + base[120:]), (1, None), (2, ""), (4, "x" * 49), (5, "x" * 50), (6, "x" * 500), (8, "ab" * 300), (10, "ba" * 300 + base[200:]), (11, base), (11, base), (12, "y" + base[50:99] + "z"), (13, base[50:100]), (None, base[30:90]), (-4, base[10:70]), (14, word(50) + base[5:55] + word(50))]
    for _ in range(60):
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((rng.randrange(20, 60), word(rng.randrange(60)) + base[a:b] + word(rng.randrange(60))))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (64, 1000, 1 << 20):
        assert run(docs, block_bytes=block, bucket_bytes=256) == want
    assert run(docs, block_bytes=500, length=21) == brute(rows, 21)


def test_empty_table_and_remaining_texts(spark):
    docs = spark.createDataFrame([(1, "q" * 60 + "abc"), (2, "start " + "q" * 60 + " end"), (3, None)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in suffix_dedup.remaining_texts(docs).collect()} == {1: "q" * 60 + "abc", 2: "start  end", 3: ""}


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    text = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    rows = [(1, text), (2, text[:1200] + "x" + text[1200:]), (3, "y" * 1000), (4, "z" + text[7:2990]), (5, "y" * 51), (6, text[100:160])]
    known = [suffix_dedup.Rounds(50, 4, 0)]
    for block in (10_000, 1_000_000):
        packed = next(suffix_dedup_blocks(rows, block))
        b, _ = known[0].block(packed)
        assert len(b.pieces) > 5 and (b.pieces[:, 1] - b.pieces[:, 0] < 350).all()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)


def suffix_dedup_blocks(rows, block):
    data = [(t or "").encode() for _, t in rows]
    yield {"doc_ids": [i for i, _ in rows], "sizes": [len(d) for d in data], "text": b"".join(data)}


def test_buckets_are_even():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(32, 127, 2_000_000, dtype=np.uint8).tobytes()
    values, _, _ = suffix_dedup.Block(np.arange(200), np.full(200, 10_000), text, 50).first_entries()
    for buckets in (32, 1024):
        many = np.diff(suffix_dedup._buckets(values, buckets))
        assert many.sum() == len(values) and many.max() < 2 * many.mean()


def test_remaining_texts_of_repeated_rows(spark):
    rows = [(5, "k" * 70), (5, "k" * 70), (None, "k" * 60 + "end"), (2, None), (1, "k" * 55)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in suffix_dedup.remaining_texts(docs).collect())
    # the fifteen bytes of 5 after the shared fifty-five start no string of fifty that is in 1, but are covered by one
    assert got == [("1", "k" * 55), ("2", ""), ("5", ""), ("5", ""), ("None", "end")]
