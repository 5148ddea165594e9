"""Phrase collocations against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrygraph.llm import phrases

SCHEMA = "lang string, text string"


def brute(rows, min_count, top=2000, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 6):
                for i in range(len(w) - d + 1):
                    f[lang, tuple(w[i : i + d])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    over = Counter()
    for (lang, p), a in cand.items():
        for d in range(2, len(p)):
            for i in range(len(p) - d + 1):
                over[lang, p[i : i + d]] = max(over[lang, p[i : i + d]], a)
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) in over and 100 * over[lang, p] >= percent * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def got(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["the", "of", "New", "York", "éa", "z\x0bq", " x", "on", "a", "b", "c", "A\x00", "日本"]
    out = []
    for k in range(150):
        words = rng.choices(vocabulary, weights=[60, 30, 9, 9, 5, 2, 2, 9, 5, 5, 5, 2, 2], k=rng.randint(0, 120))
        text = ""
        for w in words:
            text += w + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " new york of the on "])
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return [*out, ("en", None), ("fr", None), ("fr", ".."), ("de", "same same same same same same " * 40)]


@pytest.mark.parametrize("budget,block", [(2 << 20, 16 << 20), (300, 2000), (40, 500)])
def test_against_brute_force(spark, rows, budget, block):
    want = brute(rows, 12)
    assert len(want) > 100
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count=12, budget=budget, block_bytes=block)) == want


@pytest.mark.parametrize("piece,words", [(1, 23), (90, 400)])
def test_long_texts_in_slices(spark, rows, piece, words):
    rows = [*rows, ("en", "\n".join(t or "" for lang, t in rows)), ("en", "the of new york " * 300)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(phrases.collocations(table, min_count=12, budget=300, block_bytes=700, piece_bytes=piece, slice_words=words)) == brute(rows, 12)


def test_top_and_percent(spark, rows):
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count=12, percent=60, top=7)) == brute(rows, 12, 7, 60)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_BYTES", 11)
    words = [w for found in phrases._chunks(b"abc defg  hijklm no \n pqrstuvwxyz0123456789 a b " * 5) for w in found]
    assert words == [b"abc", b"defg", b"hijklm", b"no", b"\n", b"pqrstuvwxyz0123456789", b"a", b"b"] * 5


def test_large_numbers_are_exact(spark):
    a, n, l, r = 10**13 + 7, 10**16 + 3, 10**14 - 3, 10**13 + 99
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    text = "(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    assert row.selectExpr(f"cast({text} as bigint) as s").first().s == 1000 * a * n // (l * r)


def test_empty_clashing_and_long(spark):
    assert got(phrases.collocations(spark.createDataFrame([], SCHEMA))) == []
    long = "a b c " * 400_000 + "x" * 200_000
    table = spark.createDataFrame([("en", long, 1, "f", 2), ("en", long, 1, "f", 2)], SCHEMA + ", p int, word string, `a.b` int")
    assert got(phrases.collocations(table)) == brute([("en", long)] * 2, 100)


def test_rare_pairs_end_a_suffix():
    stream = np.array([1, 2, 3, 0, 1, 2, 4, 0, 5, 1, 2, 0], np.int64)
    bits = 20
    found = np.zeros(1 << bits, np.uint8)
    found[phrases._counter(np.array([1, 2]), np.array([2, 3]), bits)] = 1
    (cols,) = phrases._suffixes(stream, 5, 100, (bits, np.packbits(found)))
    assert np.stack(cols[:3], axis=1).tolist() == [[1, 2, 3], [2, 3, 0], [1, 2, 0], [1, 2, 0]]


@pytest.mark.parametrize("share,most,wide,bucket", [(1, 27, 3, 10), (16, 5, 4, 1), (10**6, 27, 18, 1 << 19)])
def test_pair_counters_lose_nothing(spark, monkeypatch, rows, share, most, wide, bucket):
    for name, value in {"PAIR_SHARE": share, "PAIR_BITS": most, "RANGE_BITS": wide, "BUCKET_WORDS": bucket}.items():
        monkeypatch.setattr(phrases, name, value)
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count=12, budget=300, block_bytes=2000)) == brute(rows, 12)


def test_words_travel_once_and_packed(spark, rows):
    blocks = phrases.write_shared(spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "text").mapInArrow(phrases._blocks(2000, 1 << 20), phrases._BLOCK), "test-blocks")
    words, replies = phrases._vocabulary(blocks, 12)
    once = Counter((lang, w) for lang, text in rows for w in re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) for lang in ["und" if lang is None else lang])
    assert {(r.lang, r.word): r.f for r in words.collect()} == {k: n for k, n in once.items() if n >= 12}
    assert sorted(r.id for r in words.collect()) == list(range(1, words.count() + 1))
    assert replies.selectExpr("max(size(replies)) AS n").first().n == 1
