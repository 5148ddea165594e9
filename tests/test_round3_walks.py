"""Findings of round 3 that projected figures beyond the limits of 6 GB."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import blocks, graph, impact, retrieval


def plain_ranks(nodes, pairs, seeds, alpha=0.25, iterations=25):
    at = {v: k for k, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, t in pairs:
        if s in at and t in at:
            m[at[s], at[t]] += 1
            m[at[t], at[s]] += 1
    r = np.zeros(len(nodes))
    for v, w in seeds.items():
        r[at[v]] = w / sum(seeds.values())
    degree = m.sum(axis=1)
    rank, reached = r.copy(), r > 0
    for _ in range(iterations):
        lost = rank[degree == 0].sum()
        rank = alpha * r + (1 - alpha) * ((rank / np.where(degree, degree, 1)) @ m + lost * r)
        reached |= (reached @ (m > 0)) > 0
    return {v: rank[k] / rank.max() for v, k in at.items() if reached[k]}


@pytest.mark.parametrize("part_nodes", [1 << 19, 7])
def test_ranks_of_packed_parts_equal_plain_ones(spark, monkeypatch, part_nodes):
    monkeypatch.setattr(blocks, "PART_NODES", part_nodes)
    ids = [f"n{k}" for k in range(60)]
    pairs = [(f"n{k}", f"n{(k * k + 3) % 50}") for k in range(50)] + [("n1", "n2"), ("n1", "n2"), ("n3", "n3"), ("n4", "gone"), ("n55", "n56")]
    seeds = {"n1": 2.0, "n17": 1.0, "n58": 3.0}
    nodes = spark.createDataFrame([(v,) for v in ids], "id string").repartition(5)
    edges = spark.createDataFrame([(s, t, "calls") for s, t in pairs], "source string, target string, relation string")
    got = {r.id: r["rank"] for r in graph.personalized_pagerank(nodes, edges, spark.createDataFrame(list(seeds.items()), "id string, weight double")).collect()}
    want = plain_ranks(ids, pairs, seeds)
    assert got.keys() == want.keys() and "n55" not in got
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_a_round_sends_numbers_without_ids(spark):
    """Two cliques: a round's messages are 8 bytes for each node a part reaches, not a row for each edge."""
    import pyarrow as pa

    size = 50
    pairs = [(s, t) for s in range(size) for t in range(s)]
    edges = pa.table({"p": [0] * len(pairs), "a": [s for s, _ in pairs], "q": [0] * len(pairs), "b": [t for _, t in pairs], "n": [1] * len(pairs)})
    built = blocks.build(edges, pa.table({"p": [0], "num": [7], "r": [1.0], "q": [0.0]}))
    sent = blocks.step(0, False, 0.25, 12)(built, None)
    assert [len(y.as_py()) for y in sent.column("y")] == [8 * size]


def walked(spark):
    edges = spark.createDataFrame([("b", "a", "references"), ("b", "a", "calls"), ("c", "b", "imports"), ("c", "a2", "extends"), ("d", "c", "calls")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("p/x", "a"), ("p/y", "a2"), (None, "c")], "origin string, id string")
    return edges, seeds


def test_grouped_walks_keep_groups_depths_and_first_relations(spark):
    edges, seeds = walked(spark)
    got = {tuple(r) for r in graph.walk(edges, seeds, 2, "in", group="origin").collect()}
    assert got == {("p/x", "b", 1, "calls"), ("p/x", "c", 2, "imports"), ("p/y", "c", 1, "extends"), ("p/y", "d", 2, "calls"), (None, "d", 1, "calls")}
    assert {tuple(r) for r in graph.walk(edges, seeds.where("id = 'a'"), None, "in").collect()} == {("b", 1, "calls"), ("c", 2, "imports"), ("d", 3, "calls")}


def test_a_walks_rounds_hash_rows_and_do_not_sort_them_for_a_least_string(spark, monkeypatch):
    plans = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    edges, seeds = walked(spark)
    graph.walk(edges, seeds, 2, "in", group="origin")
    assert len(plans) == 5 and not any("SortAggregate" in p for p in plans)


def test_modules_count_origins_of_all_their_symbols(spark):
    nodes = spark.createDataFrame([("i", "m/a.py"), ("j", "m/a.py"), ("k", "m/b.py"), ("l", "n/c.py"), ("z", "m/z.py")], "id string, path string")
    hit = spark.createDataFrame([("i", ["p", "q"]), ("j", ["p", "q"]), ("k", ["q", "r"]), ("l", ["p"]), ("z", ["s"])], "id string, origins array<string>")
    changed = spark.createDataFrame([("m/z.py",)], "path string")
    assert sorted(map(tuple, impact.modules(hit, nodes, changed).collect())) == [("m", 3, 2, 3), ("n", 1, 1, 1)]


def test_an_index_splits_its_texts_once(spark):
    docs = spark.createDataFrame([("a", "readFile", "x/a.py", "open the file, readFile twice: file"), ("b", None, "x/b.py", None)], "id string, name string, path string, body string")
    index = retrieval.build_index(docs)
    for table in (index.postings, index.df, index.stats, index.lengths):
        assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, index.lengths.collect())) == [("a", 6), ("b", 0)]
    assert tuple(index.stats.first()) == (2, 3.0)
    assert {("a", "name", "read", 1), ("a", "body", "file", 3), ("b", "path", "py", 1)} <= set(map(tuple, index.postings.collect()))
    assert dict(map(tuple, index.df.collect()))["file"] == 1
