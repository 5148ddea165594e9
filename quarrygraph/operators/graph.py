"""Graph operators over ``nodes(id, name, kind, path, ...)`` and ``edges(source, target, relation, ...)``.

Edge targets need not be nodes (external names): every lookup of an endpoint is a left join. Iterations write each
round to the shared checkpoint folder, so lineage stays short and lost executors cost a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions.text import SUBJECT_WORD, path_under
from quarrygraph.operators import blocks
from quarrygraph.plans.shared import cut, drop

#: Relations that a walk follows (all but containment), and kinds.
WALK_RELATIONS = ("calls", "references", "imports", "extends", "implements")
INCOMING_RELATIONS = ("calls", "references", "implements", "extends")
OUTGOING_RELATIONS = ("calls", "references", "imports", "implements", "extends")
INCOMING = r"\b(caller|callers|calls?\s+into|who\s+calls|what\s+calls|called\s+by|used\s+by|uses)\b"
OUTGOING = r"\b(callee|callees|what\s+does\s+\S+\s+call|calls\s+what|imports?|depends\s+on)\b"
KINDS = ("file", "module", "class", "interface", "struct", "enum", "trait", "function", "method", "type", "constant", "variable")
RELATIONS = (*WALK_RELATIONS, "contains")


def walks(relation: str | Column = "relation") -> Column:
    return (F.col(relation) if isinstance(relation, str) else relation).isin(*WALK_RELATIONS)


def resolve_symbol(nodes: DataFrame, query: str, under: str | None = None) -> DataFrame:
    """Nodes of the best tier that ``query`` names: 1 the id, for a query with ``#`` the only one; 2 the name, or the
    id's end behind ``#`` or ``.`` but for ordinals; 3 the last dotted segment as a name; 4 a file's name, path or end of
    its path, for a query with a dot. Case counts for ids only. ``under`` then keeps paths below a prefix, which some
    node must have."""
    q = query.lower()
    file = F.col("kind") == "file"
    if "#" in query:
        tier = F.when(F.col("id") == query, 1)
    else:
        tail = F.regexp_replace(F.regexp_extract("id", "#(.*)$", 1), r"~[0-9]+(?=\.|$)", "")
        plain = F.lower(F.when(F.contains("id", F.lit("#")), F.concat(F.lit("#"), tail)).otherwise(F.col("id")))
        tier = F.when(~file & ((F.lower("name") == q) | plain.endswith("#" + q) | plain.endswith("." + q)), 2)
        last = q.rsplit(".", 1)[-1]
        if "." in q and "::" not in q and last:
            tier = tier.when(~file & (F.lower("name") == last), 3)
        if "." in q:
            path = F.lower("path")
            tier = tier.when(file & ((F.lower("name") == q) | (path == q) | path.endswith("/" + q)), 4)
    hit = nodes.withColumn("tier", tier).where("tier is not null")
    best = hit.agg(F.min("tier").alias("tier"))  # one row
    out = hit.join(F.broadcast(best), "tier")
    if under:
        below = path_under(F.col("path"), F.lit(under))
        if nodes.where(below).isEmpty():
            raise ValueError(f"no indexed path below {under!r}")
        out = out.where(below)
    return out


def neighbours(nodes: DataFrame, edges: DataFrame, subjects: DataFrame, direction: str, relations: tuple[str, ...] = WALK_RELATIONS) -> DataFrame:
    """``(subject, id, relation, name, path)`` one hop into or out of ``subjects(id)``; an endpoint that is no node
    keeps its raw id as its name."""
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    hit = edges.where(F.col("relation").isin(*relations)).join(subjects.select(F.col("id").alias(near)).distinct(), near, "left_semi")
    hit = hit.select(F.col(near).alias("subject"), F.col(far).alias("id"), "relation").distinct()
    return hit.join(nodes.select("id", "name", "path"), "id", "left").select("subject", "id", "relation", F.coalesce("name", "id").alias("name"), "path")


def callers(nodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    return neighbours(nodes, edges, subjects, "in")


def callees(nodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    return neighbours(nodes, edges, subjects, "out")


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None = 2, direction: str = "in", group: str | None = None) -> DataFrame:
    """``(id, depth, relation)``: every id within ``depth`` hops of ``seeds(id)``, once, at its least depth, without the
    seeds; the relation is the first in order of those that reach it at that depth. ``depth`` None walks on until
    nothing is new. With ``group`` the walks from each value of that column of ``seeds`` run side by side.
    """
    keys = ["__group"] if group else []
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    # relations and groups are numbers in the loop: a least string is found by sorting rows, a least number by hashing them
    names = F.array(*[F.lit(r) for r in sorted(WALK_RELATIONS)])
    steps = cut(edges.where(walks()).select(F.col(near).alias("near"), F.col(far).alias("id"), F.array_position(names, F.col("relation")).cast("int").alias("relation")), "steps")
    if group:
        groups = cut(seeds.select(group).distinct().withColumn("__group", F.monotonically_increasing_id()), "groups")
        begun = seeds.join(groups, seeds[group].eqNullSafe(groups[group])).select("__group", "id")
    else:
        begun = seeds.select("id")
    frontier = cut(begun.distinct(), "walk")
    seen = frontier
    found = None
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        reached = frontier.select(*keys, F.col("id").alias("near")).join(steps, "near").groupBy(*keys, "id").agg(F.min("relation").alias("relation"))
        fresh = cut(reached.join(seen, [*keys, "id"], "left_anti").withColumn("depth", F.lit(hop)), "walk")
        if fresh.isEmpty():
            break
        found = fresh if found is None else found.unionByName(fresh)
        frontier = fresh.select(*keys, "id")
        seen = seen.unionByName(frontier)
    columns = [*([group] if group else []), "id", "depth", "relation"]
    if found is None:
        return seeds.select(*columns[:-2]).limit(0).withColumn("depth", F.lit(0)).withColumn("relation", F.lit("")).select(*columns)
    if group:
        found = found.join(groups, "__group")
    return found.withColumn("relation", F.element_at(names, F.col("relation"))).select(*columns)


def file_seeds(nodes: DataFrame, path: str) -> DataFrame:
    """The file's node and all symbols in it."""
    return nodes.where(F.col("path") == path).select("id")


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.25, iterations: int = 25, partition: str | None = None, cut_every: int = 5, digits: int = 12) -> DataFrame:
    """``([partition], id, rank)``: undirected restart walk over ``seeds([partition], id, weight)``, largest rank 1.

    Parallel edges count each; edges to ids that aren't nodes, and with ``partition`` (a column of ``nodes``) edges
    between partitions, are left out; mass at nodes without neighbours goes back to the seeds. All partitions iterate
    in one loop, over packed blocks of the edges. Ranks are rounded to ``digits`` after each step.
    """
    key = partition or "__all"
    of = F.col(partition) if partition else F.lit(0)
    spark = nodes.sparkSession
    # positions in the table stand for ids in the loop; written, because they must not change
    own = nodes.select("id", of.alias(key), F.monotonically_increasing_id().alias("own")).groupBy("id", key).agg(F.min("own").alias("own"))
    own = cut(own, "ids").withColumn("task", F.shiftright("own", 33)).withColumn("row", F.col("own").bitwiseAND(F.lit((1 << 33) - 1)))
    before, offsets = 0, []
    for task, rows in sorted(map(tuple, own.groupBy("task").agg(F.max("row") + 1).collect())):  # one row a task
        offsets.append((task, before))
        before += rows
    ids = own.join(F.broadcast(spark.createDataFrame(offsets, "task bigint, offset bigint")), "task").select("id", key, (F.col("offset") + F.col("row")).alias("num"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-before // blocks.PART_NODES))
    width = max(1, -(-before // parts))
    # parts are called by numbers that Spark deals to different tasks, else some would hold several parts and others none
    names = spark.range(64 * parts).groupBy(F.expr(f"pmod(hash(id), {parts})")).agg(F.min("id").alias("name")).orderBy("name").limit(parts).select("name")
    names = [r.name for r in names.collect()]
    names += [64 * parts + k for k in range(parts - len(names))]
    part = lambda num: F.element_at(F.lit(names).cast("array<bigint>"), F.expr(f"{num} div {width}").cast("int") + 1)
    start = seeds.withColumn(key, of).where("weight > 0").groupBy(key, "id").agg(F.sum("weight").alias("weight")).join(ids, [key, "id"])
    total = start.groupBy(key).agg(F.sum("weight").alias("total"))
    start = cut(start.join(total, key).select(key, "num", (F.col("weight") / F.col("total")).alias("r")), "start")
    # a walk stays in its partition, so edges of one without seeds carry nothing
    near = ids.join(start.select(key).distinct(), key, "left_semi") if partition else ids
    # a target lies in the part where most of its sources stand, all others in the part of their position
    a = near.select(F.col("id").alias("source"), F.col(key).alias("ka"), F.col("num").alias("a"))
    b = near.select(F.col("id").alias("target"), F.col(key).alias("kb"), F.col("num").alias("b"))
    joins = max(parts, -(-before // blocks.JOIN_NODES))
    # the few ids of a part are hashed, not its edges sorted. Targets are written in order, where they pack well, here and
    # when they are dealt, and the shuffles behind the edges are done with
    left = edges.where(walks()).select("source", "target").repartition(joins, "source").join(a.hint("shuffle_hash"), "source").drop("source")
    left = cut(left.sortWithinPartitions("target"), "left")
    # dealt by a number for the target, which later steps group by in its stead; that targets are equal is no key of the join
    b = b.select(F.xxhash64("target").alias("h"), F.col("target").alias("same"), "kb", "b")
    ends = left.withColumn("h", F.xxhash64("target")).repartition(joins, "h").join(b.hint("shuffle_hash"), "h").where("target >= same and target <= same")
    # not as <=>, which Spark would take for a key of the join; rows dealt by h alone stay so in all steps below
    ends = ends.where(F.size(F.array_distinct(F.array("ka", "kb"))) == 1) if partition else ends
    ends = ends.groupBy("h", "b", "a").agg(F.count("*").alias("n")).withColumn("pa", part("a"))
    ends = ends.withColumn("here", F.sum("n").over(Window.partitionBy("b", "pa", "h")))
    most = F.max(F.struct("here", F.xxhash64("b", "pa").alias("tie"), "pa")).over(Window.partitionBy("b", "h"))
    ends = cut(ends.select("a", "b", "n", "pa", most["pa"].alias("pb")), "ends")
    drop(left)
    placed = ends.select(F.col("b").alias("num"), F.col("pb").alias("place")).distinct()
    touched = ends.select(F.explode(F.array("a", "b")).alias("num")).join(start.select("num"), "num", "left_semi").distinct().withColumn("touched", F.lit(True))
    restart = start.join(touched, "num", "left").withColumn("alone", F.col("touched").isNull())
    # mass arrives over edges both ways, so only seeds can lack neighbours, and what they hold follows from their share
    alone = restart.where("alone").groupBy(key).agg(F.sum("r").alias("lost"))
    restart = cut(restart.join(alone, key, "left").select("num", "r", "alone", ((1 - alpha) * F.coalesce("lost", F.lit(0.0))).alias("q")), "restart")
    begun = restart.where("not alone").join(placed, "num", "left").select(F.coalesce("place", part("num")).alias("p"), "num", "r", "q")
    # edges travel packed: to where their source stands by its position, which learns its place there, and on to both places
    packed = ends.mapInArrow(blocks.pack, blocks.PACKED).repartition(parts, "p").groupBy("p")
    places = placed.select(part("num").alias("p"), "num", "place").repartition(parts, "p").groupBy("p")
    dealt = packed.cogroup(places).applyInArrow(blocks.deal, blocks.PACKED)
    held = table = cut(dealt.repartition(parts, "p").groupBy("p").cogroup(begun.repartition(parts, "p").groupBy("p")).applyInArrow(blocks.gather, blocks.BLOCK), "blocks")
    drop(start, ends)
    # dealt once, in as many tasks as the loop's rounds; a lost part comes again from the table above
    held = held.repartition(parts, "p").persist()
    sent, spent = spark.createDataFrame([], blocks.MESSAGE), []
    for k in range(iterations + 1):
        last = k == iterations
        sent = held.groupBy("p").cogroup(sent.repartition(parts, "to").groupBy("to")).applyInArrow(blocks.step(k, last, alpha, digits), "num bigint, rank double" if last else blocks.MESSAGE)
        if last or k % cut_every == cut_every - 1:
            sent = cut(sent, "rank")
            drop(*spent)
            spent = [sent]
    held.unpersist()
    drop(table)
    q = F.pow("q", F.lit(iterations - 1))
    stays = F.col("r") * (alpha + F.col("q") * (q + alpha * (1 - q) / (1 - F.col("q"))))
    rank = sent.unionByName(restart.where("alone").select("num", F.round(stays if iterations else F.col("r"), digits).alias("rank")))
    named = rank.join(ids, "num")
    top = named.groupBy(key).agg(F.max("rank").alias("top"))
    out = named.join(F.broadcast(top) if partition is None else top, key).where("top > 0").select(key, "id", (F.col("rank") / F.col("top")).alias("rank"))
    return out if partition else out.drop(key)


def in_degree(edges: DataFrame, relations: tuple[str, ...] | None = WALK_RELATIONS) -> DataFrame:
    """``(id, degree)``; ``relations`` None counts all."""
    some = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    return some.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("degree"))


def top_hubs(nodes: DataFrame, edges: DataFrame, cap: int, per: Column | None = None) -> DataFrame:
    """Symbols by in-degree, then name, then path; ``cap`` of all, or of each value of ``per``."""
    symbols = nodes.where("kind <> 'file'").join(in_degree(edges), "id")
    order = [F.col("degree").desc(), F.col("name"), F.col("path")]
    if per is None:
        return symbols.orderBy(*order).limit(cap)
    keyed = symbols.withColumn("key", per)
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= cap)


def structural(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 8) -> tuple[str | None, DataFrame | None]:
    """Routes a question about callers or callees: its direction and the neighbours of the subject, or (None, None)
    where the question asks for neither or names no symbol. Words are tried longest first."""
    import re

    import regex

    q = query.lower()
    direction = "in" if re.search(INCOMING, q) else "out" if re.search(OUTGOING, q) else None
    if direction is None:
        return None, None
    found = regex.findall(SUBJECT_WORD, query)
    words = sorted({v for w in found for v in ([w, w[:-2]] if w.endswith("()") else [w]) if v}, key=lambda w: (-len(w), w))
    for word in words:
        subjects = resolve_symbol(nodes.where("kind <> 'file'"), word)
        if not subjects.isEmpty():
            relations = INCOMING_RELATIONS if direction == "in" else OUTGOING_RELATIONS
            found = neighbours(nodes, edges, subjects, direction, relations)
            return direction, found.dropDuplicates(["id", "relation"]).orderBy(F.coalesce("path", "id"), "id", "relation").limit(limit)
    return None, None


def union_edges(*parts: DataFrame) -> DataFrame:
    """Distinct (source, relation, target); the confidence of the earliest part wins."""
    strong = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    out = strong[0]
    for p in strong[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("source", "relation", "target").agg(F.min_by("confidence", "part").alias("confidence"))


def descendants(edges: DataFrame) -> DataFrame:
    """``(id, n)``: how many ids lie below each over containment, which is a forest."""
    below = edges.where("relation = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("leaf"))
    hop, total = below, below
    while True:
        hop = cut(hop.join(below.select(F.col("id").alias("leaf"), F.col("leaf").alias("next")), "leaf").select("id", F.col("next").alias("leaf")), "tree")
        if hop.isEmpty():
            return total.groupBy("id").agg(F.count("*").alias("n"))
        total = total.unionByName(hop)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(what, value, n)`` by kind and by relation."""
    kinds = nodes.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "value", "n")
    relations = edges.groupBy(F.col("relation").alias("value")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "value", "n")
    return kinds.unionByName(relations)


def quality_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, self loops, edges to ids that aren't nodes, symbols, and those of them without any walk edge."""
    ids = nodes.select(F.col("id").alias("target"), F.lit(1).alias("known"))
    e = edges.join(ids, "target", "left").agg(F.count("*").alias("edges"), F.sum((F.col("source") == F.col("target")).cast("bigint")).alias("self_loops"), F.sum(F.col("known").isNull().cast("bigint")).alias("external"))
    touched = edges.where(walks()).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    symbols = nodes.where("kind <> 'file'")
    s = symbols.agg(F.count("*").alias("symbols"))
    o = symbols.join(touched, "id", "left_anti").agg(F.count("*").alias("orphans"))
    return e.crossJoin(s).crossJoin(o).withColumn("orphan_percent", F.round(100.0 * F.col("orphans") / F.nullif("symbols", F.lit(0)), 2))  # one row each


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(rule, id)``: duplicate ids, empty names, unknown kinds and relations, and sources that aren't nodes."""
    found = [
        nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("rule"), "id"),
        nodes.where("coalesce(name, '') = ''").select(F.lit("empty_name"), "id"),
        nodes.where(~F.coalesce("kind", F.lit("")).isin(*KINDS)).select(F.lit("unknown_kind"), "id"),
        edges.where(~F.coalesce("relation", F.lit("")).isin(*RELATIONS)).select(F.lit("unknown_relation"), F.col("source")),
        edges.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").select(F.lit("dangling_source"), F.col("source")).distinct(),
        edges.where(F.col("relation") != "imports").join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select(F.lit("dangling_target"), F.col("target")).distinct(),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def repo_map(nodes: DataFrame, edges: DataFrame, max_dirs: int = 16, hubs: int = 3, threshold: float = 0.6) -> DataFrame:
    """``(dir, files, symbols, languages, hubs)``: directories by symbols, then path. A first segment that holds more
    than ``threshold`` of the files is split one level deeper."""
    files = nodes.where("kind = 'file'")
    first = files.groupBy(F.substring_index("path", "/", 1).alias("seg")).agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("total"))
    split = first.crossJoin(F.broadcast(total)).where(F.col("n") > threshold * F.col("total")).select(F.col("seg").alias("split"))  # at most one row
    keyed = nodes.join(F.broadcast(split), F.substring_index(F.col("path"), "/", 1) == F.col("split"), "left")
    keyed = keyed.withColumn("dir", F.when(F.col("split").isNotNull(), F.substring_index("path", "/", 2)).otherwise(F.substring_index("path", "/", 1)))
    stats = keyed.groupBy("dir").agg(F.sum((F.col("kind") == "file").cast("bigint")).alias("files"), F.sum((F.col("kind") != "file").cast("bigint")).alias("symbols"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "file", F.col("language")))), ",").alias("languages"))
    best = top_hubs(keyed, edges, hubs, F.col("dir")).groupBy(F.col("key").alias("dir")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ",").alias("hubs"))
    top = stats.orderBy(F.col("symbols").desc(), "dir").limit(max_dirs)
    return top.join(best, "dir", "left").select("dir", "files", "symbols", "languages", F.coalesce("hubs", F.lit("")).alias("hubs"))
