"""Scopes: discovery from markers, nearest-prefix assignment, the substance guard, and federation over children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import text as T

from . import retrieval

#: Least symbols of a scope, deepest marker directory.
MIN_SYMBOLS, MAX_DEPTH = 5, 2


def prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(path, prefix)``: each path with all its directory prefixes and the root ''."""
    plain = paths.select(F.col(path).alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return plain.select("path", F.explode(above).alias("prefix"))


def assign_scope(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(path, prefix)``: the longest scope prefix above each path, or the root ''. An equality join on exploded
    prefixes, so neither side is broadcast or compared with all of the other."""
    keyed = prefixes(paths.select("path").distinct())
    own = keyed.join(scopes.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").distinct().join(own, "path", "left").select("path", F.coalesce("prefix", F.lit("")).alias("prefix"))


def discover(markers: DataFrame) -> DataFrame:
    """``(prefix, label, markers)`` of ``markers(dir, marker)``: directories with a marker at most two levels deep; a
    directory below another marked one of the same marker is part of it."""
    shallow = markers.where((F.col("dir") == "") | (F.size(F.split("dir", "/")) <= MAX_DEPTH))
    above = prefixes(shallow.select(F.col("dir").alias("path")).distinct()).where("prefix <> '' and prefix <> path")
    owned = above.join(shallow.select(F.col("dir").alias("prefix"), "marker"), "prefix").select(F.col("path").alias("dir"), "marker").distinct()
    kept = shallow.join(owned, ["dir", "marker"], "left_anti")
    label = F.when(F.col("dir") == "", "root").otherwise(T.basename(F.col("dir")))
    return kept.groupBy(F.col("dir").alias("prefix")).agg(F.array_sort(F.collect_set("marker")).alias("markers"), F.min(label).alias("label")).select("prefix", "label", "markers")


def fold_small(assigned: DataFrame, least: int = MIN_SYMBOLS) -> DataFrame:
    """``(prefix, symbols)`` where scopes with fewer than ``least`` symbols are part of the root; the root stays."""
    n = assigned.groupBy("prefix").agg(F.count("*").alias("symbols"))
    to = F.when((F.col("symbols") >= least) | (F.col("prefix") == ""), F.col("prefix")).otherwise("")
    return n.groupBy(to.alias("prefix")).agg(F.sum("symbols").alias("symbols"))


def under_prefix(paths: DataFrame, prefix: str) -> DataFrame:
    """Rows below a prefix; a prefix with none is an error, not an empty result."""
    out = paths.where(T.path_under(F.col("path"), F.lit(prefix)))
    if out.isEmpty():
        raise ValueError(f"nothing indexed under {prefix!r}")
    return out


def federate_rows(children: dict[str, DataFrame], path: str = "path", id_: str = "id") -> DataFrame:
    """All children's rows with a ``child`` column and ids and paths below the child's name."""
    out = None
    for child, rows in sorted(children.items()):
        one = rows.withColumn("child", F.lit(child)).withColumn(path, F.concat(F.lit(child + "/"), path)).withColumn(id_, F.concat(F.lit(child + "/"), id_))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def federated_ranking(scored: DataFrame, limit: int = 8) -> DataFrame:
    """``(id, child, score, position)`` of ``scored(id, child, file, score, strong, broad)``: children below the
    strength gate are left out, the file leaders are fused by reciprocal rank, the best hit of all is first, and files
    then take turns."""
    gate = scored.groupBy("child").agg(F.max("strong").alias("s"), F.max("broad").alias("b")).where((F.col("s") >= retrieval.STRONG_FLOOR) | (F.col("b") >= retrieval.HIGH_FLOOR))
    open_ = scored.join(gate.select("child"), "child", "left_semi")
    leaders = open_.groupBy("child", "file").agg(F.max("score").alias("score"))
    fused = retrieval.fuse_ranks(leaders.select(F.concat_ws("/", "child", "file").alias("id"), F.col("child").alias("scope"), "score")).withColumnRenamed("score", "fused")
    best = open_.agg(F.max(F.struct("score", F.col("id")))["id"].alias("lock"))
    rows = open_.withColumn("group", F.concat_ws("/", "child", "file")).join(fused.select(F.col("id").alias("group"), "fused"), "group").crossJoin(F.broadcast(best))  # one row
    place = F.struct((F.col("id") != F.col("lock")).alias("l"), (-F.round("fused", 9)).alias("f"), F.col("group"), (-F.col("score")).alias("s"), F.col("id"))
    return retrieval.round_robin(rows.withColumn("place", place), "group", "place", limit).select("id", "child", "score", F.col("position").cast("bigint").alias("position"))


def children_loaded(children: DataFrame, graphs: DataFrame) -> DataFrame:
    """``(child, state)``: loaded or missing."""
    have = graphs.select("child").distinct().withColumn("__have", F.lit(1))
    return children.join(have, "child", "left").select("child", F.when(F.col("__have").isNotNull(), "loaded").otherwise("missing").alias("state"))


def unique_suffix(names: DataFrame, paths: DataFrame) -> DataFrame:
    """``(name, path)``: the one path whose file name is ``name``; ambiguous names have none."""
    keyed = paths.select("path", T.basename(F.col("path")).alias("name")).distinct()
    one = keyed.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    return names.select("name").distinct().join(one, "name", "left").select("name", "path")
