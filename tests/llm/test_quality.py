import re
from collections import Counter

import numpy as np
import pytest

from quarrygraph.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] >= 2 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


ODD = ["", "   \n\t", "a", "é ü\xa0ß x", "a b c d e " * 5, "x\ny\nx\n\nx \n", "# * $", "日本 語 z", "one two three four five six seven eight nine ten", "w" * 30000 + " end", "\n\n"]


def test_base_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(2 * 10**6, None), (None, "a b")], "doc_id long, text string")
    rows = docs.unionByName(odd).collect()
    got = quality.quality_rules(docs.unionByName(odd), quality.KEEP_ALL, chunk_bytes=9000).collect()
    expect = sorted((r.doc_id if r.doc_id is not None else -1, *brute(r.text or "")) for r in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == expect
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality is not null")
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.quality_rules(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality", "base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.97
    assert np.mean([not r.kept for r in bad]) > 0.9


@pytest.mark.parametrize("kind", ["empty", "one_class", "nulls"])
def test_labels_without_both_kinds_keep_everything(spark, kind):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    rows = {"empty": [], "one_class": [(1, 1)], "nulls": [(None, 0), (1, None)]}[kind]
    model = quality.fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert [r.kept for r in quality.quality_rules(docs, model).collect()] == [True]
    assert quality.quality_rules(docs.limit(0), model).count() == 0
