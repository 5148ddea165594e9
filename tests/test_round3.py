"""Findings of round 3: work is dealt over tasks, parsed once, and ties are broken."""

from pyspark.sql import functions as F

from quarrygraph.operators import extract, retrieval
from quarrygraph.plans import views


def small_files(spark):
    return spark.range(0, 40, 1, 1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("import os\n\nclass A(B):\n    def f(self):\n        x = C()\n        if x:\n            return x.g(lambda: h(1))\n"), F.lit("# "), "id").alias("text"), F.lit("python").alias("language"))


def test_files_of_one_task_are_parsed_by_many(spark):
    files = small_files(spark)
    assert files.rdd.getNumPartitions() == 1
    for rows in (extract.extract_nodes(files), extract.extract_raw_edges(files)):
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_one_parse_gives_nodes_and_numbered_raw_edges(spark):
    files = small_files(spark)
    nodes, raw = extract.extract_both(files)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, extract.extract_nodes(files).collect()))
    assert sorted(map(str, raw.drop("edge").collect())) == sorted(map(str, extract.extract_raw_edges(files).collect()))
    assert raw.count() == raw.select("edge").distinct().count() == raw.agg(F.count("edge")).first()[0] > 0
    assert {(r.source, r.name, r.recv_type) for r in raw.where("relation = 'calls' and file = 'm7.py'").collect()} == {("m7.py#A.f", "C", None), ("m7.py#A.f", "g", "C"), ("m7.py#A.f", "h", None)}


def test_equal_scores_of_equal_scopes_go_to_the_first_scope(spark):
    rows = [(f"d{k}", scope, 1.0 + k) for k in range(40) for scope in ("c", "b", "a")] + [("e", "b", 9.0), ("e", "c", 9.0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "id string, scope string, score double").repartition(4)
        got = {r.id: r.scope for r in retrieval.combine_scores(docs).collect()}
        assert got == {f"d{k}": "a" for k in range(40)} | {"e": "b"}


def test_parts_of_the_edges_follow_the_bytes_of_their_table(spark, sf_dir, monkeypatch):
    whole = views.view(spark, sf_dir, "edges").groupBy("relation").agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "target") % 1000003).alias("h")).collect()
    monkeypatch.setattr(views, "PART_BYTES", views._bytes(spark, f"{sf_dir}/lineitem.parquet") // 29)
    dealt = views.view(spark, sf_dir, "edges")
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [l_orderkey") == 3 and ", 29" in plan
    assert sorted(dealt.groupBy("relation").agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "target") % 1000003).alias("h")).collect()) == sorted(whole)
