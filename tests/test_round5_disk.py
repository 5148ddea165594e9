"""PageRank on little disk: spent shuffles and tables go, edges and messages travel packed."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from quarrygraph.operators import blocks, graph
from quarrygraph.plans import shared
from tests.test_round3_walks import plain_ranks


def shuffle_files(spark):
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(kept.apply(k).getName().startswith("shuffle_") for k in range(kept.size()))


def test_a_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).selectExpr("id % 701 AS k").repartition(4, "k")
    before, known = shuffle_files(spark), spark.conf.get(shared.CLEANUP, None)
    found = shared.cut(rows.groupBy("k").count(), "counts")
    assert shuffle_files(spark) <= before and spark.conf.get(shared.CLEANUP, None) == known
    assert found.count() == 701


def test_only_tables_of_its_own_are_dropped(spark, tmp_path):
    table = shared.cut(spark.range(3).toDF("k"), "some")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    shared.drop(table)
    assert not os.path.exists(folder)
    spark.range(3).write.parquet(str(tmp_path / "given"))
    with pytest.raises(ValueError):
        shared.drop(spark.read.parquet(str(tmp_path / "given")))


def chain(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(40)], "id string").repartition(3)
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * k + 3) % 40}", "calls") for k in range(39)] + [("n1", "gone", "calls")], "source string, target string, relation string")
    return nodes, edges, spark.createDataFrame([("n1", 2.0), ("n9", 1.0)], "id string, weight double")


def test_ranks_leave_the_tables_that_they_are_read_from(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(blocks, "PART_NODES", 7)
    ranks = graph.personalized_pagerank(*chain(spark))
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(tmp_path / "cut")) == ["ids", "rank", "restart"]
    pairs = [(f"n{k}", f"n{(k * k + 3) % 40}") for k in range(39)]
    want = plain_ranks([f"n{k}" for k in range(40)], pairs, {"n1": 2.0, "n9": 1.0})
    got = {r.id: r["rank"] for r in ranks.collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_parts_are_dealt_to_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART_NODES", 4)
    seen = []

    def cut(df, name, whole=graph.cut):
        out = whole(df, name)
        if name == "blocks":
            seen.extend(r.p for r in out.select("p").distinct().collect())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    graph.personalized_pagerank(*chain(spark))
    tasks = {r[0] for r in spark.createDataFrame([(p,) for p in seen], "p bigint").selectExpr("pmod(hash(p), 10)").collect()}
    assert len(seen) > 5 and len(tasks) == len(seen)


def test_messages_compress(spark):
    """Ranks have twelve digits and most are small, so of a number's 8 bytes the high ones are alike."""
    size = 20000
    some = np.random.default_rng(1)
    edges = pa.table({"p": np.zeros(size, np.int64), "a": np.arange(size), "q": np.zeros(size, np.int64), "b": size + some.integers(0, 900, size), "n": np.ones(size, np.int64)})
    starts = pa.table({"p": np.zeros(size, np.int64), "num": np.arange(size), "r": some.dirichlet(np.ones(size)), "q": np.zeros(size)})
    y = blocks.step(0, False, 0.25, 12)(blocks.build(edges, starts), None).column("y")[0].as_py()
    assert len(y) == 8 * (size + len(set(edges.column("b").to_pylist())))
    assert len(pa.compress(y, "lz4", asbytes=True)) < 0.75 * len(y)


def test_packed_edges_give_the_same_parts_in_fewer_bytes():
    some = np.random.default_rng(2)
    size = 30000
    a, b = np.sort(some.integers(0, 4000, size)), some.integers(4000, 5000, size)
    rows = pa.table({"a": a, "b": b, "n": np.ones(size, np.int64), "pa": a // 2500 + 3, "pb": b % 2 + 3})
    places = {3: pa.table({"p": [3], "num": [5], "place": [9]}), 4: pa.table({"p": [4], "num": [1], "place": [3]})}
    packed = pa.Table.from_batches(list(blocks.pack(iter(rows.to_batches(max_chunksize=700)))))
    assert sum(len(v.as_py()) for v in packed.column("arrays")) < 5 * size
    dealt = pa.concat_tables([blocks.deal(packed.filter(pa.compute.equal(packed["p"], p)), places[p]) for p in (3, 4)])
    # row by row, as each edge is kept where its ends stand
    pa_ = np.where(a == 5, 9, a // 2500 + 3)
    pb = b % 2 + 3
    out = pa_ != pb
    p, q, x, y = (np.concatenate([u, v[out]]) for u, v in ((pa_, pb), (pb, pa_), (a, b), (b, a)))
    assert sorted(set(p)) == sorted(set(dealt["p"].to_pylist())) == [3, 4, 9]
    starts = pa.table({"p": pa.array([], pa.int64()), "num": pa.array([], pa.int64()), "r": pa.array([], pa.float64()), "q": pa.array([], pa.float64())})
    for part in (3, 4, 9):
        got = blocks.gather(dealt.filter(pa.compute.equal(dealt["p"], part)), starts)
        k = p == part
        want = blocks.build(pa.table({"p": p[k], "a": x[k], "q": q[k], "b": y[k], "n": np.ones(k.sum(), np.int64)}), starts)
        assert got.column("q").to_pylist() == want.column("q").to_pylist()
        for g, w in zip(got.column("arrays").to_pylist(), want.column("arrays").to_pylist(), strict=True):
            assert {c: v.tolist() for c, v in blocks._unpack(g).items()} == {c: v.tolist() for c, v in blocks._unpack(w).items()}


def test_arrays_come_back_as_they_were():
    kept = {"rising": np.array([5, 5, 9, 2**40]), "mixed": np.array([7, -3, 2**50]), "small": np.array([1, 1, 1], np.int32), "none": np.zeros(0, np.int64), "real": np.array([0.5, np.pi, 0.0])}
    back = blocks._unpack(blocks._pack(**kept))
    assert all(back[c].dtype == v.dtype and back[c].tolist() == v.tolist() for c, v in kept.items())
