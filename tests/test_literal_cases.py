"""Scalar functions and symbol resolution on cases written out by hand."""

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import graph


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("label,want", [
    ("Concept: Cache", "Cache"),
    ("Incremental Build via Content Fingerprints", "Incremental Build"),
    ("Token Index: a sidecar beside the graph file", "Token Index"),
    ("Map of every directory in the repository", "Map of every directory in the…"),
    ("Reciprocal-Rank Fusion Workspace Federation", "Reciprocal-Rank Fusion…"),
    ("x" * 40, "x" * 30 + "…"),
    ("  short  ", "short"),
])
def test_short_label(spark, label, want):
    assert one(spark, T.short_label, label) == want


@pytest.mark.parametrize("name,want", [
    ("TestRetriesThreeTimes", "retries three times"),
    ("test_loads_the_graph", "loads the graph"),
    ("describe drops-stale rows", "drops stale rows"),
    ("shouldLoad2Files", None),
    ("TestOk", None),
    ("Test_LoadsTheGraph", "loads the graph"),
])
def test_humanize(spark, name, want):
    assert one(spark, T.humanize_test_name, name) == want


@pytest.mark.parametrize("body,want", [("# head\n\n- item\n  prose here ", "prose here"), ("* starred", "* starred"), ("-item\n<!-- c -->", ""), ("> quoted", "> quoted")])
def test_first_prose(spark, body, want):
    assert one(spark, T.first_prose, body) == want


def test_slice_span(spark):
    text = "\n".join(f"l{k}" for k in range(1, 101))
    cut = lambda a, b, cap=80: one(spark, lambda x: T.slice_span(x, F.lit(a), F.lit(b), cap, F.lit("a.ts")), text)
    assert cut(-4, 2) == "l1\nl2" and cut(99, 400) == "l99\nl100" and cut(101, 120) == ""
    assert cut(1, 5, 2) == "l1\nl2\n… (+3 more lines; open a.ts:L1-L5)"


def test_subject_words_and_relations(spark):
    assert one(spark, T.subject_words, "who calls evict() in pkg.Cache") == ["pkg.Cache", "evict()", "calls", "evict", "who", "in"]
    assert [one(spark, T.relation_family, x) for x in ("contains", "imports", "extends", "references", "unheard")] == ["structure", "dependency", "contract", "association", "association"]
    assert [one(spark, T.normalize_relation, x) for x in ("influences", "measures", "calls")] == ["configures", "validates", "calls"]


@pytest.mark.parametrize("query,under,want", [
    ("Evict", None, ["src/a.ts#Cache.evict", "src/b.ts#evict~2"]),
    ("cache.evict", None, ["src/a.ts#Cache.evict"]),
    ("other.evict", None, ["src/a.ts#Cache.evict", "src/b.ts#evict~2"]),
    ("other::evict", None, []),
    ("src/a.ts#Cache.evict", None, ["src/a.ts#Cache.evict"]),
    ("a.ts#Cache.evict", None, []),
    ("a.ts", None, ["src/a.ts"]),
    ("src/a.ts", None, ["src/a.ts"]),
    ("evict", "src/b.ts", ["src/b.ts#evict~2"]),
])
def test_resolve_symbol(spark, query, under, want):
    rows = [("src/a.ts", "a.ts", "file", "src/a.ts"), ("src/a.ts#Cache", "Cache", "class", "src/a.ts"), ("src/a.ts#Cache.evict", "evict", "method", "src/a.ts"), ("src/b.ts#evict~2", "evict", "function", "src/b.ts")]
    nodes = spark.createDataFrame(rows, "id string, name string, kind string, path string")
    assert sorted(r.id for r in graph.resolve_symbol(nodes, query, under).collect()) == want
    with pytest.raises(ValueError, match="no indexed path"):
        graph.resolve_symbol(nodes, query, "nowhere")
