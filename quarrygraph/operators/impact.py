"""Blast radius of a change: seeds, impacted symbols by changed file, modules, areas, owners and reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T
from quarrygraph.plans.shared import cut

from .graph import in_degree, walk
from .intervals import changed_symbols

#: Half life in days, least share of an owner, owners of an area, weight of affected areas, reviewers.
HALF_LIFE, MIN_SHARE, PER_AREA, AFFECTED_WEIGHT, REVIEWERS, MAX_AREAS = 120.0, 0.15, 2, 0.6, 3, 5
BEHAVIOURAL = ("function", "method", "class")


def seeds(changed: DataFrame, ranges: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """``(origin, id)``: the changed files' innermost touched symbols, and the file itself where no symbol is touched.
    ``changed(path)``, ``files(id, path)``."""
    touched = changed_symbols(ranges, spans).select(F.col("path").alias("origin"), "id")
    plain = changed.select(F.col("path").alias("origin")).distinct().join(touched, "origin", "left_anti").join(files.select(F.col("path").alias("origin"), "id"), "origin")
    return touched.unionByName(plain.select("origin", "id"))


def blast(edges: DataFrame, seeds_: DataFrame, depth: int = 2) -> DataFrame:
    """``(id, depth, origins)``: every dependent with its least depth over all changed files and the files it was
    reached from; all files walk side by side."""
    reached = walk(edges, seeds_, depth, "in", group="origin")
    return reached.groupBy("id").agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("origin")).alias("origins"))


def modules(impacted: DataFrame, nodes: DataFrame, changed: DataFrame, module: Column | None = None) -> DataFrame:
    """``(module, symbols, files, origins)`` of impacted nodes outside the changed files, by directory or by a given
    expression of the path."""
    key = T.dirname(F.col("path")) if module is None else module
    hit = impacted.join(nodes.select("id", "path"), "id").join(changed.select("path").distinct(), "path", "left_anti")
    alike = cut(hit.groupBy(key.alias("module"), "path", "origins").agg(F.count("*").alias("n")), "alike")  # read twice
    sizes = alike.groupBy("module").agg(F.sum("n").alias("symbols"), F.count_distinct("path").alias("files"))
    met = alike.select(F.col("module").alias("of"), F.explode("origins").alias("origin")).groupBy("of").agg(F.count_distinct("origin").alias("origins"))
    return sizes.join(met, F.col("module").eqNullSafe(F.col("of")), "left").select("module", "symbols", "files", F.coalesce("origins", F.lit(0)).cast("bigint").alias("origins"))


def areas(seed_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``(area, files, seeds, behavioural, reached, tests)`` of ``seed_nodes(id)`` outside tests: directories with their
    behavioural symbols, those that a test reaches, and na, changed, stale or none for the state of the tests."""
    paths = nodes.select(F.col("id").alias("source"), F.col("path").alias("test"))
    from_tests = edges.join(paths, "source").where(T.is_test_path(F.col("test"))).select(F.col("target").alias("id"), "test").distinct()
    touched = changed.select(F.col("path").alias("test"), F.lit(1).alias("also_changed")).distinct()
    signal = from_tests.join(touched, "test", "left").groupBy("id").agg(F.count("*").alias("tests"), F.count("also_changed").alias("changed_tests"))
    s = seed_nodes.select("id").distinct().join(nodes, "id").where(~T.is_test_path(F.col("path"))).join(signal, "id", "left")
    behavioural = F.col("kind").isin(*BEHAVIOURAL)
    out = s.groupBy(T.dirname(F.col("path")).alias("area")).agg(
        F.count_distinct("path").alias("files"),
        F.count("*").alias("seeds"),
        F.sum(behavioural.cast("bigint")).alias("behavioural"),
        F.sum((behavioural & (F.coalesce("tests", F.lit(0)) > 0)).cast("bigint")).alias("reached"),
        F.sum(F.coalesce("tests", F.lit(0))).alias("n"),
        F.sum(F.coalesce("changed_tests", F.lit(0))).alias("c"),
    )
    tests = F.when(F.col("behavioural") == 0, "na").when(F.col("c") > 0, "changed").when(F.col("n") > 0, "stale").otherwise("none")
    return out.withColumn("tests", tests).drop("n", "c")


def coarsen(groups: dict[str, int], most: int = MAX_AREAS) -> dict[str, str]:
    """Folds the deepest directories into their parents until at most ``most`` are left: old to new name. For a report's
    table of areas, which is small by its nature."""
    size, target = dict(groups), {g: g for g in groups}
    parent = lambda d: d.rsplit("/", 1)[0] if "/" in d else ""
    while len(size) > most:
        keys = sorted(size, key=lambda d: (-d.count("/"), size[d]))
        pick = next((d for d in keys if parent(d) and parent(d) in size), None) or next((d for d in keys if parent(d)), None)
        if pick is None:
            break
        size[parent(pick)] = size.get(parent(pick), 0) + size.pop(pick)
        target = {g: parent(pick) if t == pick else t for g, t in target.items()}
    return target


def shared_concept(files: DataFrame, group: str, concept: str) -> DataFrame:
    """``(group, concept)`` where all of a group's files agree on one, else null."""
    one = F.when((F.count_distinct(concept) == 1) & (F.count(concept) == F.count("*")), F.min(concept))
    return files.groupBy(group).agg(one.alias("concept"))


def smallest_claim(claims: DataFrame) -> DataFrame:
    """``(path, concept)``: of the concepts that claim a path the one with the fewest sources, then the first name."""
    sizes = claims.groupBy("concept").agg(F.count_distinct("path").alias("n"))
    return claims.join(sizes, "concept").groupBy("path").agg(F.min_by("concept", F.struct("n", "concept")).alias("concept"))


def owners(commits: DataFrame, now: Column, area: str = "area", exclude: list[str] | None = None) -> DataFrame:
    """``(area, author, commits, score, share, place)`` of ``commits(hash, made_at, author, email, area)``: bots and excluded
    people aside, a commit counts once an author and area and halves in weight every 120 days; at most two owners of a
    share of 15 % or more."""
    out = {e.strip().lower() for e in exclude or ()}
    person = F.lower(F.coalesce(T.github_handle(F.col("email")), F.col("email")))
    people = commits.where(~T.is_bot(F.col("author"), F.col("email"))).withColumn("person", person)
    if out:
        people = people.where(~F.lower("email").isin(*out) & ~F.lower("author").isin(*out) & ~F.col("person").isin(*out))
    age = (now.cast("timestamp").cast("double") - F.col("made_at").cast("timestamp").cast("double")) / 86400.0
    once = people.groupBy(area, "person", "hash").agg(F.min(T.decay(age, HALF_LIFE)).alias("weight"), F.min("author").alias("author"))
    sums = once.groupBy(area, "person").agg(F.count("*").alias("commits"), F.round(F.sum("weight"), 6).alias("score"), F.min("author").alias("author"))
    shares = sums.withColumn("share", F.round(F.col("score") / F.sum("score").over(Window.partitionBy(area)), 6))
    placed = shares.withColumn("place", F.row_number().over(Window.partitionBy(area).orderBy(F.col("score").desc(), F.col("commits").desc(), "author")))
    return placed.where((F.col("share") >= MIN_SHARE) & (F.col("place") <= PER_AREA)).select(area, "author", "commits", "score", "share", "place")


def reviewers(changed: DataFrame, affected: DataFrame, most: int = REVIEWERS) -> DataFrame:
    """``(author, weighted, commits, areas)``: owners of changed areas in full and of affected ones by 0.6, the first
    three."""
    both = changed.withColumn("w", F.lit(1.0)).unionByName(affected.withColumn("w", F.lit(AFFECTED_WEIGHT)))
    out = both.groupBy("author").agg(F.round(F.sum(F.col("score") * F.col("w")), 6).alias("weighted"), F.sum("commits").alias("commits"), F.count("*").alias("areas"))
    return out.orderBy(F.col("weighted").desc(), F.col("commits").desc(), "author").limit(most)


def test_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, tests)``: how many test files have an edge to each node."""
    paths = nodes.where(T.is_test_path(F.col("path"))).select(F.col("id").alias("source"), "path")
    return edges.join(paths, "source").groupBy(F.col("target").alias("id")).agg(F.count_distinct("path").alias("tests"))


def outside_dependents(edges: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """``(source, target, relation)``: edges into a file's nodes from elsewhere."""
    own = nodes.where(F.col("path") == path).select("id")
    into = edges.join(own.select(F.col("id").alias("target")), "target", "left_semi")
    return into.join(own.select(F.col("id").alias("source")), "source", "left_anti").select("source", "target", "relation")


__all__ = [n for n in dir() if not n.startswith("_")] + ["in_degree"]
