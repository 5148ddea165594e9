"""Concepts, rules and digests: markdown nodes joined to code, merged by slug and linked by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T


def merge_concepts(parts: DataFrame) -> DataFrame:
    """``(slug, name, summary, sources)``: parts of one slug become one concept with the longest summary and all
    sources. ``parts(name, summary, sources)``."""
    keyed = parts.withColumn("slug", T.slugify(F.col("name")))
    return keyed.groupBy("slug").agg(F.min("name").alias("name"), F.max_by("summary", F.struct(F.length("summary"), F.col("summary"))).alias("summary"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def link_concepts(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(slug, to, relation)``: targets by name, whatever their case and spaces; unknown ones and a concept's own are
    left out, repeats too. ``links(slug, target, relation)``, ``concepts(slug, name)``."""
    key = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"\s+", " "))
    names = concepts.groupBy(key("name").alias("key")).agg(F.min("slug").alias("to"))
    return links.withColumn("key", key("target")).join(names, "key").where("slug <> to").select("slug", "to", "relation").distinct()


def inherit_sources(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """``(slug, sources)``: a concept without sources takes those of the concepts that it links to, one step away."""
    have = concepts.where(F.size("sources") > 0).select("slug", "sources")
    bare = concepts.where(F.size("sources") == 0).select("slug")
    taken = bare.join(links, "slug").join(have.select(F.col("slug").alias("to"), "sources"), "to").groupBy("slug").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return have.unionByName(bare.join(taken, "slug", "left").select("slug", F.coalesce("sources", F.expr("cast(array() as array<string>)")).alias("sources")))


def covers(concepts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(slug, path, symbols)``: a concept's sources with the symbols of each file in order."""
    at = concepts.select("slug", F.explode("sources").alias("path"))
    per_file = symbols.where("kind <> 'file'").groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("symbols"))
    return at.join(per_file, "path", "left").select("slug", "path", F.coalesce("symbols", F.expr("cast(array() as array<string>)")).alias("symbols"))


def known_links(links: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between known concepts, and one row with the number of others."""
    slugs = concepts.select(F.col("slug").alias("to"))
    return links.join(slugs, "to", "left_semi"), links.join(slugs, "to", "left_anti").agg(F.count("*").alias("dropped"))


def attach_rules(rules: DataFrame, nodes: DataFrame, pointers: DataFrame, most: int = 6) -> DataFrame:
    """``(rule, symbol, stale)``: the first distinct rules of the symbols pointed at; stale where the symbol changed
    since. ``rules(symbol, rule, fingerprint)``, ``nodes(id, hash)``, ``pointers(id)``."""
    hit = rules.join(pointers.select(F.col("id").alias("symbol")).distinct(), "symbol", "left_semi").join(nodes.select(F.col("id").alias("symbol"), "hash"), "symbol")
    stale = (F.coalesce("fingerprint", F.lit("")) != "") & (F.col("fingerprint") != F.col("hash"))
    one = hit.withColumn("stale", stale).groupBy("rule").agg(F.min(F.struct("symbol", "stale")).alias("s"))
    return one.select("rule", "s.symbol", "s.stale").orderBy("rule").limit(most)


def commit_symbols(commits: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """``(hash, symbols)``: at most ``most`` symbols of the files of a commit, in order. ``commits(hash, path)``."""
    hit = commits.select("hash", "path").distinct().join(symbols.where("kind <> 'file'").select("path", "name"), "path").select("hash", "name").distinct()
    placed = hit.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("name"))).where(F.col("n") <= most)
    return placed.groupBy("hash").agg(F.array_sort(F.collect_list("name")).alias("symbols"))


def cards(symbols: DataFrame, order: Column) -> DataFrame:
    """``(path, card)``: a file's symbols as a markdown list in order."""
    rows = symbols.where("kind <> 'file'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("name"), F.col("kind")))).alias("s"))
    line = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["kind"], F.lit(" `"), x["name"], F.lit("`"))), "\n")
    return rows.select("path", F.concat(F.lit("# "), "path", F.lit("\n\n"), line, F.lit("\n")).alias("card"))


def scope_footer(hits: DataFrame, scope: str = "scope") -> DataFrame:
    return hits.groupBy(scope).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), scope)


def stale_manifest(files: DataFrame, manifest: DataFrame, covered: DataFrame) -> DataFrame:
    """``(path, state)``: changed against the manifest, removed, uncovered by any concept, or unindexed."""
    f = files.select("path", F.col("hash").alias("now"))
    m = manifest.select("path", F.col("hash").alias("was"))
    c = covered.select("path").distinct().withColumn("covered", F.lit(1))
    j = f.join(m, "path", "full_outer").join(c, "path", "left")
    state = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "unindexed").when(F.col("was") != F.col("now"), "changed").when(F.col("covered").isNull(), "uncovered").otherwise("fresh")
    return j.select("path", state.alias("state"))
