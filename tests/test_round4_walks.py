"""Ranks by partition: edges of partitions without seeds are left out before the loop."""

from quarrygraph.operators import graph


def test_partitions_without_seeds_carry_nothing(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"{s}{k}", s) for s in ("x", "y") for k in range(6)], "id string, scope string")
    nodes = nodes.unionByName(spark.createDataFrame([("z0", None), ("z1", None)], "id string, scope string"))
    edges = spark.createDataFrame([(f"{s}{k}", f"{s}{(k + 1) % 6}", "calls") for s in ("x", "y") for k in range(5)] + [("x0", "y0", "calls"), ("z0", "z1", "calls")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("x", "x1", 2.0), ("x", "x4", 1.0), ("y", "y2", 0.0), (None, "z0", 1.0)], "scope string, id string, weight double")
    sizes = {}

    def cut(df, name, whole=graph.cut):
        out = whole(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(graph, "cut", cut)
    ranks = graph.personalized_pagerank(nodes, edges, seeds, partition="scope")
    assert sizes["ends"] == 5
    found = {r.id: r["rank"] for r in ranks.collect()}
    alone = spark.createDataFrame([(f"x{k}", "x") for k in range(6)], "id string, scope string")
    want = {r.id: r["rank"] for r in graph.personalized_pagerank(alone, edges, seeds.where("scope = 'x'").select("id", "weight")).collect()}
    assert sorted(found) == [f"x{k}" for k in range(6)] and all(abs(found[k] - want[k]) < 1e-9 for k in want)
