import datetime

from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import impact, retrieval, sessions
from quarrygraph.sources import files, history


def test_patches_and_logs(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n+a\n@@ -9 +12 @@ def f\n+b\n@@ -20,3 +22,0 @@\n-c\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = history.parse_patches(spark.createDataFrame([(patch,)], "text string"))
    assert sorted(map(tuple, got.collect())) == [("x.py", 1, 3), ("x.py", 12, 12), ("x.py", 22, 22)]
    status = spark.createDataFrame([("M\ta",), ("R090\tb\tc",), ("D\td",), ("junk",)], "text string")
    assert sorted(map(tuple, history.parse_name_status(status).collect())) == [("a", "modified", None), ("c", "renamed", "b"), ("d", "deleted", None)]
    log = "\x01h1\x022024-01-31T00:00:00Z\x02Ann\x027+ann@users.noreply.github.com\n\na.py\nb.py\n\x01h2\x02bad\x02B\x02b@x\nc.py\n\x01h3\x022023-10-03T00:00:00Z\x02ci[bot]\x02c@x\n\na.py\n"
    commits = history.parse_log(spark.createDataFrame([(log,)], "text string"))
    assert {(r.hash, r.path) for r in commits.collect()} == {("h1", "a.py"), ("h1", "b.py"), ("h3", "a.py")}
    own = impact.owners(commits.withColumn("area", F.lit("all")), F.lit("2024-01-31")).collect()
    assert [(r.author, r.commits, r.share) for r in own] == [("Ann", 1, 1.0)]
    assert impact.owners(commits.withColumn("area", F.lit("all")), F.lit("2024-01-31"), exclude=["ANN"]).count() == 0


def test_graph_json_concepts_and_transcripts(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"meta": {"version": 1}, "nodes": [{"id": "a", "kind": "file", "path": "a"}],\n "edges": [{"source": "a", "target": "b", "relation": "imports"}]}')
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().id == "a" and edges.first().target == "b"
    (tmp_path / "bad.json").write_text("{")
    assert files.read_graph(spark, str(tmp_path / "bad.json"))[0].count() == 0
    files.write_graph(nodes, edges, str(tmp_path / "out"))
    assert "body_text" not in files.load_graph(spark, str(tmp_path / "out"))[0].columns
    md = tmp_path / "md"
    md.mkdir()
    (md / "one.md").write_text('---\nname: "One thing"\ntype: concept\n---\n# T\n\nFirst line.\n')
    (md / "INDEX.md").write_text("x")
    got = files.read_concepts(spark, str(md)).withColumn("prose", T.first_prose(F.col("body"))).collect()
    assert [(r.slug, r.name, r.type, r.prose) for r in got] == [("one", "One thing", "concept", "First line.")]
    (tmp_path / "t.jsonl").write_text('{"type": "assistant", "message": {"id": "m1", "usage": {"input_tokens": 5}}}\nnot json\n{"type": "assistant", "message": {"id": "m1", "usage": {"input_tokens": 7}}}\n{"type": "user"}\n')
    turn = files.last_assistant_turn(files.read_transcript(spark, str(tmp_path / "t.jsonl"))).collect()
    assert [(r.id, r.input_tokens) for r in turn] == [("m1", 7)]


def test_decoding_and_classes(spark):
    rows = [(1, b"abc"), (2, b"\xef\xbb\xbfabc"), (3, b"\xff\xfe" + "é".encode("utf-16-le")), (4, b"\xfe\xff\x00a"), (5, b"")]
    got = spark.createDataFrame(rows, "id int, content binary").select("id", files.decode(F.col("content")).alias("t")).collect()
    assert {r.id: r.t for r in got} == {1: "abc", 2: "abc", 3: "é", 4: None, 5: ""}
    names = [("a.py", "", "native"), ("b.vue", "", "container"), ("c.pm", "", "perl"), ("run", "#!/usr/bin/env perl\n", "perl"), ("run", "#!/bin/bash\n", "generic"), ("x.rs", "", "generic"), ("x.txt", "", None)]
    frame = spark.createDataFrame(names, "path string, prefix string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", files.classify(F.col("path"), F.col("prefix"))).collect())


def test_fusion_does_not_depend_on_order_or_scale(spark):
    rows = [(f"a{k}", "a", 1.0 - k / 20) for k in range(10)] + [("b0", "b", 1.0), ("b1", "b", 0.5), ("c0", "c", 0.2)]
    one = {r.id: (r.scope, r.score) for r in retrieval.fuse_ranks(spark.createDataFrame(rows, "id string, scope string, score double")).collect()}
    two = {r.id: (r.scope, r.score) for r in retrieval.fuse_ranks(spark.createDataFrame(rows[::-1], "id string, scope string, score double")).collect()}
    assert one == two and one["a0"][1] == one["b0"][1] == 1.0 and "c0" not in one
    lone = retrieval.fuse_ranks(spark.createDataFrame(rows[:3], "id string, scope string, score double"))
    assert {r.id: r.score for r in lone.collect()} == {"a0": 1.0, "a1": 0.95, "a2": 0.9}


def test_coarsening_and_breaker(spark):
    groups = {"a/b/c": 1, "a/b/d": 2, "a/b": 1, "x/y": 1, "z": 4, "q": 1, "w": 1}
    assert len(set(impact.coarsen(groups).values())) == 5 and impact.coarsen(groups)["a/b/c"] == "a/b"
    rows = [("g", k, o) for k, o in enumerate(["failed", "quality", "failed", "ok", "failed", "failed", "failed", "ok"])]
    got = sessions.circuit_breaker(spark.createDataFrame(rows, "run string, seq int, outcome string"), "run", "seq", 3).first()
    assert (got.tried, got.stopped) == (7, True)
    assert datetime.datetime(2024, 1, 1)
