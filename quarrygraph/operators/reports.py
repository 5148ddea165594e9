"""Smaller report, evidence and upkeep operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T

from .graph import personalized_pagerank
from .retrieval import combine_scores

#: Lines of a crux, lives of cached rules in hours and of pages in days, pages kept.
CRUX_LINES, RULES_HOURS, EMPTY_RULES_HOURS, PAGE_DAYS, PAGES = 12, 6.0, 2 / 60, 14, 500
#: Fixed classes of errors: codes, then statuses, then words of the message.
ERROR_CODES = {"ENOSPC": "E_DISK", "EDQUOT": "E_DISK", "EACCES": "E_PERMISSION", "EPERM": "E_PERMISSION", "ENOMEM": "E_OOM", "ETIMEDOUT": "E_TIMEOUT", "ESOCKETTIMEDOUT": "E_TIMEOUT", "ENOTFOUND": "E_NETWORK", "ECONNREFUSED": "E_NETWORK", "ECONNRESET": "E_NETWORK"}


def error_class(code: Column, status: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ERROR_CODES.items() for x in pair]), code)
    rest = (
        F.when(status.isin(401, 403), "E_AUTH").when(status == 429, "E_RATE_LIMIT").when(status >= 500, "E_LLM")
        .when(m.contains("timeout") | m.contains("timed out"), "E_TIMEOUT").when(m.contains("parse") | m.contains("syntax"), "E_PARSE").when(m.contains("lock"), "E_LOCK")
        .otherwise("E_UNKNOWN")
    )
    return F.coalesce(known, rest)


def clean_label(x: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(x, r"[\r\n]+", " "), r"[<>\"'`|(){}\[\]#]", "")
    return T.short_label(F.trim(F.regexp_replace(flat, r"\s+", " ")))


def prefixed_pointers(child: Column, pointers: Column) -> Column:
    """A comma list of pointers below a child; parts with spaces are prose and stay."""
    one = lambda p: F.when((F.trim(p) == "") | F.trim(p).contains(" "), p).otherwise(F.concat(child, F.lit("/"), F.trim(p)))
    return F.array_join(F.transform(F.split(pointers, ","), one), ", ")


def shifted_span(span: Column, by: Column) -> Column:
    lo, hi = T.span_bounds(span)
    return F.when(lo.isNotNull(), F.concat(F.lit("L"), (lo + by).cast("string"), F.lit("-L"), (hi + by).cast("string"))).otherwise(span)


def crux_span(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """The asked range within the node's span, at most twelve lines, as ``struct(start, end)``; null for a bad range."""
    a = F.greatest(lo, F.least(start, hi))
    b = F.greatest(a, F.least(end, hi))
    return F.when((start >= 1) & (end >= start), F.struct(a.alias("start"), F.least(b, a + (CRUX_LINES - 1)).alias("end")))


def rules_stale(checked: Column, now: Column, rules: Column) -> Column:
    hours = (now.cast("timestamp").cast("double") - checked.cast("timestamp").cast("double")) / 3600
    return checked.isNull() | (hours > F.when(rules == 0, EMPTY_RULES_HOURS).otherwise(RULES_HOURS))


def relevant(hits: DataFrame, seen: DataFrame, strong: Column, broad: Column, cap: int = 3) -> DataFrame:
    """The first hits that weren't shown before, none where the match is weak. ``hits(session, pointer, place)``."""
    open_ = hits.where((strong >= 0.1) | (broad >= 0.5)).join(seen, ["session", "pointer"], "left_anti")
    return open_.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("place"))).where(F.col("n") <= cap).drop("n")


def duplicate_ordinals(names: DataFrame, base: str, order: str) -> DataFrame:
    """Ids in document order: the first of a base keeps it, later ones get ``~2``, ``~3``."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return names.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("~"), n.cast("string"))))


def capped_with_rest(rows: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """``(key, shown, more)``: how many rows of a key are listed and how many are only counted."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).select(key, F.least("n", F.lit(cap)).cast("bigint").alias("shown"), F.greatest(F.col("n") - cap, F.lit(0)).cast("bigint").alias("more"))


def impact_table(modules: DataFrame, top: int = 5) -> DataFrame:
    """``(module, symbols, files)``: the largest modules, and one row '(smaller)' for the rest. The windowless form: the
    top rows are taken by a heap in each task, the rest is totals less them."""
    head = modules.orderBy(F.col("symbols").desc(), "module").limit(top)
    total = modules.agg(F.sum("symbols").alias("s"), F.sum("files").alias("f"), F.count("*").alias("n"))
    own = head.agg(F.sum("symbols").alias("s0"), F.sum("files").alias("f0"), F.count("*").alias("n0"))
    rest = total.crossJoin(own).where("n > n0").select(F.lit("(smaller)").alias("module"), (F.col("s") - F.col("s0")).alias("symbols"), (F.col("f") - F.col("f0")).alias("files"))  # one row each
    return head.select("module", "symbols", "files").unionByName(rest)


def live_pages(pages: DataFrame, now: Column, keep: int = PAGES, days: int = PAGE_DAYS) -> DataFrame:
    """Each key's last page, not older than the limit, the newest ``keep`` of them. ``pages(key, stored, body)``."""
    last = pages.groupBy("key").agg(F.max_by(F.struct("stored", "body"), "stored").alias("p")).select("key", "p.*")
    age = (now.cast("timestamp").cast("double") - F.col("stored").cast("timestamp").cast("double")) / 86400
    return last.where(age <= days).orderBy(F.col("stored").desc(), "key").limit(keep)


def card_paths(sources: DataFrame) -> DataFrame:
    """``(path, card)``: a card's path follows its source's; paths that are equal but for case get a hashed name."""
    plain = sources.select("path").distinct().withColumn("card", F.concat("path", F.lit(".md")))
    crowd = plain.groupBy(F.lower("card").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    hashed = F.concat(F.lit("source-"), F.substring(F.sha2("path", 256), 1, 16), F.lit(".md"))
    return plain.join(crowd, F.lower("card") == F.col("k"), "left").select("path", F.when(F.col("n").isNotNull(), hashed).otherwise(F.col("card")).alias("card"))


def missing_after(first: DataFrame, second: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """What a first pass gave, and for ids it missed what a second gave; one row an id."""
    one = first.dropDuplicates([key])
    rest = wanted.select(key).join(one.select(key), key, "left_anti")
    return one.unionByName(second.join(rest, key, "left_semi").dropDuplicates([key]))


def inline_sources(hits: DataFrame, cruxes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(pointer, code)`` of ``hits(pointer, path, span_start, span_end)``: the crux where there is one, else the span's
    lines, at most eighty."""
    joined = hits.join(cruxes.select("pointer", "crux"), "pointer", "left").join(texts.select("path", "body"), "path", "left")
    return joined.select("pointer", F.coalesce("crux", T.slice_span(F.col("body"), F.col("span_start"), F.col("span_end"), path=F.col("path"))).alias("code"))


def hunk_evidence(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """``(id, hunks, first_line)``: the changed hunks within each span."""
    from .intervals import overlapping

    return overlapping(hunks, spans).groupBy("id").agg(F.count("*").alias("hunks"), F.min(F.greatest("range_start", "span_start")).alias("first_line"))


def viz_graph(seeds: DataFrame, impacted: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their role, edges between them, and one row with the number of edges left out."""
    nodes = seeds.select("id", F.lit(True).alias("seed")).distinct().unionByName(impacted.select("id", F.lit(False).alias("seed")))
    nodes = nodes.groupBy("id").agg(F.max("seed").alias("seed")).select("id", F.when(F.col("seed"), "seed").otherwise("impacted").alias("role"))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    touching = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").agg(F.count("*").alias("n"))
    return nodes, inside, touching.crossJoin(inside.agg(F.count("*").alias("m"))).select((F.col("n") - F.col("m")).alias("dropped"))  # one row each


def rank_scopes(nodes: DataFrame, edges: DataFrame, lexical: DataFrame, scope: str = "scope") -> DataFrame:
    """``(id, scope, score)``: lexical scores by their maximum over all scopes plus half the graph rank within the scope,
    combined over the scopes that take part. All scopes' ranks come from one loop."""
    from .retrieval import participating  # noqa: F401  (the gate that combine_scores applies)

    placed = lexical.join(nodes.select("id", scope), "id")
    top = lexical.agg(F.max("lexical").alias("top"))
    ranks = personalized_pagerank(nodes, edges, placed.select(scope, "id", F.col("lexical").alias("weight")), partition=scope)
    both = placed.join(ranks, [scope, "id"], "full_outer").crossJoin(F.broadcast(top))  # one row
    both = both.where(F.col("lexical").isNotNull() | (F.col("rank") >= T.RESCUE_FLOOR))
    scored = both.select("id", F.col(scope).alias("scope"), (F.coalesce(F.col("lexical") / F.col("top"), F.lit(0.0)) + T.GRAPH_WEIGHT * F.coalesce("rank", F.lit(0.0))).alias("score"))
    return combine_scores(scored)


def latest_rate(sessions: DataFrame) -> DataFrame:
    """One row ``(session, rate)``: millionths of a dollar a token in the latest session."""
    return sessions.agg(F.max_by(F.struct("session", "micros", "tokens"), F.struct("mtime", "session")).alias("s")).select("s.session", F.round(F.col("s.micros") / F.nullif("s.tokens", F.lit(0)), 6).alias("rate"))


def _named(labels: Column) -> Column:
    return F.array_join(labels, ", ")


def test_headline(areas: DataFrame) -> DataFrame:
    """``(report, headline)``: whether a change brought its tests, areas without any first. ``areas(report, place,
    label, tests)`` with tests none, stale or changed; a report has a handful of areas."""
    of = lambda state: F.transform(F.array_sort(F.collect_list(F.when(F.col("tests") == state, F.struct("place", "label")))), lambda x: x["label"])
    rows = areas.groupBy("report").agg(of("none").alias("none"), of("stale").alias("stale"), F.count_if(F.col("tests") == "changed").alias("changed"))
    parts = F.array_compact(
        F.array(
            F.when(F.size("none") > 0, F.concat(F.lit("**no test reaches "), _named(F.col("none")), F.lit("**"))),
            F.when(F.size("stale") > 0, F.concat(_named(F.col("stale")), F.when(F.size("stale") == 1, " has tests").otherwise(" have tests"), F.lit(" the diff did not touch"))),
            F.when(F.col("changed") == 1, F.lit("1 area updated its tests")).when(F.col("changed") > 1, F.concat(F.col("changed").cast("string"), F.lit(" areas updated their tests"))),
        )
    )
    return rows.where(F.size(parts) > 0).select("report", F.concat(F.lit("Tests: "), F.array_join(parts, "; "), F.lit(".")).alias("headline"))


def pack_text(title: Column, pointer: Column, snippet: Column, code: Column, place: Column) -> Column:
    """A hit as it stands in a pack: its place, title and first pointer, 140 characters of its snippet, its code."""
    first = F.trim(F.substring_index(F.coalesce(pointer, F.lit("")), ",", 1))
    short = F.substring(F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s+", " ")), 1, 140)
    return F.concat(
        F.lit(" "), place.cast("string"), F.lit(". "), title, F.lit(": "), first, F.when(short != "", F.concat(F.lit("\n    "), short)).otherwise(""),
        F.when(code != "", F.concat(F.lit("\n```\n"), code, F.lit("\n```"))).otherwise(""),
    )


def pack_savings(hits: DataFrame, baselines: DataFrame, header: str, most: int = 5) -> DataFrame:
    """``(query, pack, saved)`` in tokens: the pack of the first hits against its files read whole; nothing is claimed
    where the pack is longer. ``hits(query, place, title, pointer, snippet, code)``, ``baselines(query, chars)``."""
    block = pack_text(F.col("title"), F.col("pointer"), F.col("snippet"), F.col("code"), F.col("place"))
    packs = hits.where(F.col("place") <= most).groupBy("query").agg((F.sum(F.length(block) + 1) + len(header)).alias("n"))
    pack, base = T.to_tokens(F.col("n")), T.to_tokens(F.col("chars"))
    return packs.join(baselines, "query").select("query", pack.alias("pack"), F.when((F.col("chars") > 0) & (base > pack), base - pack).otherwise(0).cast("bigint").alias("saved"))


def rules_by_file(rules: DataFrame, most: int = 40) -> DataFrame:
    """``(file, rules)``: the first rules in order, those of no file under the empty name; the file is what stands
    before ``#`` in the symbol. ``rules(place, symbol, rule)``."""
    file = F.when(F.col("symbol").contains("#"), F.substring_index("symbol", "#", 1)).otherwise("")
    head = rules.orderBy("place").limit(most)
    return head.groupBy(file.alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule"))), lambda x: x["rule"]).alias("rules"))


def call_quotes(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, line, quote)``: the line in a hit's span that names the symbol asked about; only for hits one step away,
    since farther ones name something in between. ``hits(id, path, name, depth, span_start, span_end)``, where ``name``
    is the symbol's; ``texts(path, body)``."""
    near = hits.where((F.col("depth") <= 1) & F.col("path").isNotNull())
    numbered = near.join(texts, "path").select("id", "name", F.posexplode(F.slice(F.split("body", "\n"), F.greatest("span_start", F.lit(1)), F.greatest(F.col("span_end") - F.col("span_start") + 1, F.lit(0)))).alias("k", "text"), "span_start")
    at = numbered.where(F.expr(r"text rlike concat('\\b\\Q', name, '\\E\\b')"))
    one = at.groupBy("id").agg(F.min(F.struct((F.col("k") + F.col("span_start")).alias("line"), F.trim("text").alias("quote"))).alias("q"))
    return one.select("id", F.col("q.line").cast("bigint").alias("line"), "q.quote")
