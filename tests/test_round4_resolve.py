"""Joins of resolution whose keys are very common."""

from collections import Counter

from pyspark.sql import functions as F

from quarrygraph.operators import resolve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_go_imports_of_a_common_module_are_dealt(spark):
    raw = spark.range(4000).select(F.col("id").alias("edge"), F.lit("go").alias("language"), F.concat(F.lit("ex.org/a/d"), F.col("id").cast("string")).alias("specifier"))
    files = raw.select(F.concat(F.lit("src/d"), F.col("edge").cast("string"), F.lit("/x.go")).alias("path"))
    modules = spark.createDataFrame([("ex.org", "none"), ("ex.org/a", "src")], "module string, dir string")
    found = resolve.go_imports(raw, files, modules)
    assert found.count() == 4000 and found.where("target = concat('src/d', edge, '/x.go')").count() == 4000
    assert "BroadcastHashJoin" not in plan(found)


def test_rows_of_a_common_key_are_dealt(spark):
    many = spark.range(8000).select(F.lit("k").alias("key"), "id")
    few = spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "key string, v int")
    found = resolve._spread(many, few, ["key"], "id")
    assert found.count() == 16000 and found.select("id", "v").distinct().count() == 16000 and found.columns == ["key", "id", "v"]
    sizes = Counter(r[0] for r in many.select(F.pmod(F.xxhash64("id"), F.lit(resolve.COPIES)).alias("c")).collect())
    assert len(sizes) == resolve.COPIES and max(sizes.values()) < 2 * 8000 / resolve.COPIES


def test_common_ancestors_and_traits_are_dealt(spark):
    kinds = spark.range(3000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("owner"), "id")
    null = F.lit(None).cast("string")
    raw = kinds.select(F.col("id").alias("edge"), F.lit("php").alias("language"), F.lit(True).alias("via_member"), F.col("owner").alias("recv_type"), F.when(F.col("id") % 3 == 0, "log").when(F.col("id") % 3 == 1, "run").otherwise("top").alias("name"), F.lit("f").alias("file"), F.lit(None).cast("int").alias("arg_count"))
    rows = [("T.log", "log", "T"), ("Base.run", "run", "Base"), ("U.run", "run", "U"), ("V.top", "top", "V"), ("Root.top", "top", "Root")]
    nodes = spark.createDataFrame(rows, "id string, name string, owner string").select("id", "name", "owner", F.lit("g").alias("path"), F.lit("php").alias("language"), F.lit(None).cast("int").alias("arity"), F.lit(None).cast("boolean").alias("variadic"))
    parents = kinds.select("owner", F.lit("Base").alias("parent")).unionByName(spark.createDataFrame([("Base", "Root"), ("Root", "Base"), ("Root", None)], "owner string, parent string"))
    traits = kinds.select("owner", F.lit("T").alias("trait")).unionByName(spark.createDataFrame([("Base", "U"), ("Base", "V"), ("Other", "V")], "owner string, trait string")).unionByName(kinds.select("owner", null.alias("trait")))
    found = resolve.typed_members(raw, nodes, parents, traits)
    want = {0: "T.log", 1: "Base.run", 2: "V.top"}
    assert {(r.edge, r.target, r.confidence) for r in found.collect()} == {(k, want[k % 3], "inferred") for k in range(3000)}
    assert "BroadcastHashJoin" not in plan(found)
