import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarrygraph.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    p = np.array(prints, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(p[k] ^ p[k + 1 :]) <= 3) + k + 1:
            a, b = find(ids[k]), find(ids[int(j)])
            label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5001, None), (5002, ""), (5003, " \n"), (5004, "Two Words"), (5005, "two\twords"), (5006, "é À b c")], "doc_id long, text string")
    rows = docs.unionByName(odd).collect()
    got = {r.doc_id: r for r in simhash.simhash_components(docs.unionByName(odd), tile=64).collect()}
    prints = [brute_print(r.text) for r in rows]
    assert all(got[r.doc_id].fingerprint == f"{p:016x}" for r, p in zip(rows, prints, strict=True))
    expect = components([r.doc_id for r in rows], prints)
    assert {i: r.component_id for i, r in got.items()} == expect


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = []
    for b in base:
        prints += [int(b)] + [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(20)]
    prints = list(dict.fromkeys(prints))
    ids = list(range(len(prints)))
    points = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in zip(ids, prints, strict=True)], "fp long, id long")
    from quarrygraph.llm.common import connected_components

    got = {r.node: r.component for r in connected_components(simhash.near_links(points, tile=16)).collect()}
    assert {i: got.get(i, i) for i in ids} == components(ids, prints)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A B C")], "doc_id long, text string")
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {4}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_ids_in_any_order(spark):
    a, b = "one text of some words that is found again", "another that has no word in common but of them"
    rows = [(5, a, "x"), (5, b, "x"), (1, a, "y"), (1, a, "x"), (None, a, "z"), (None, a, "z"), (7, None, "n"), (8, "", "n")]
    kept = [(1, a, "x"), (5, b, "x"), (7, None, "n"), (None, a, "z"), (None, a, "z")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").withColumns({"__keep": F.lit(1), "row": F.lit("r"), "digest": F.lit("d")})
        got = simhash.keep_one(docs)
        assert got.columns == docs.columns
        assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted(kept, key=str)


def test_groups_of_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 2)
    rng = np.random.default_rng(9)
    prints = sorted({sum(1 << int(k) for k in rng.choice(12, 6, replace=False)) | (0xFFF << 16) for _ in range(400)})
    points = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, id long")
    from quarrygraph.llm.common import connected_components

    got = {r.node: r.component for r in connected_components(simhash.near_links(points, tile=8)).collect()}
    ids = list(range(len(prints)))
    assert {i: got.get(i, i) for i in ids} == components(ids, prints)


def test_unrelated_texts_of_one_doc_id_stay_apart(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "red orange yellow green blue indigo violet white black grey brown pink"
    for rows, want in ([[(5, a), (5, b)], {(5, a), (5, b)}], [[(1, a), (1, b), (2, b), (3, a)], {(1, a), (1, b)}]):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string")
            assert {tuple(r) for r in simhash.keep_one(docs).collect()} == want and simhash.keep_one(docs).count() == len(want)
    found = simhash.simhash_components(spark.createDataFrame([(1, a), (4, b), (2, b), (4, a)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1), (2, 2), (4, 1), (4, 2)]
