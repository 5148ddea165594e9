"""The engine's queries over the canonical views, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import drift, graph, impact, intervals, retrieval
from quarrygraph.plans.views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def scalars(name: str, source: str, columns: dict[str, tuple], key: str = "doc_id") -> None:
    """A query that only computes scalar functions: a Column of ours, made when it runs, against an SQL expression."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(key, *[make().alias(n) for n, (make, _) in columns.items()])

    QUERIES[name] = run
    ORACLES[name] = oracle(f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, (_, e) in columns.items()) + f" FROM {source}")


QUERY = "how is the work licensed under tions erance inat Thon en or de copies"
TERMS = ", ".join(f"'{t}'" for t in retrieval.query_terms(QUERY))
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens(e: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({e}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


POSTINGS = f"""tok AS (SELECT id, 'name' AS field, unnest({tokens("name")}) AS token FROM docs
      UNION ALL SELECT id, 'path', unnest({tokens("path")}) FROM docs UNION ALL SELECT id, 'body', unnest({tokens("body")}) FROM docs),
    postings AS (SELECT id, field, token, count(*) AS tf FROM tok GROUP BY ALL),
    df AS (SELECT token, count(DISTINCT id) AS df FROM tok GROUP BY token),
    lens AS (SELECT id, len({tokens("body")}) AS n FROM docs),
    stats AS (SELECT count(*) AS docs, avg(n) AS average FROM lens)"""
LEXICAL = f"""{POSTINGS},
    part AS (SELECT p.id, CASE field WHEN 'name' THEN 3 * tf * ln(1 + docs / (1 + df.df)) WHEN 'path' THEN 2 * tf * ln(1 + docs / (1 + df.df))
        ELSE ln(1 + docs / (1 + df.df)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * lens.n / average)) END AS s, p.token
      FROM postings p JOIN df USING (token) JOIN lens USING (id) CROSS JOIN stats WHERE p.token IN ({TERMS})),
    lex AS (SELECT id, sum(s) AS lexical, list_sort(list_distinct(list(token))) AS terms FROM part GROUP BY id)"""
WALK = "('calls', 'references', 'imports', 'extends', 'implements')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "docs")


def nodes_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges")


@register("g11_lexical_top", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS score FROM lex ORDER BY round(lexical, 6) DESC, id LIMIT 20")
def g11_lexical_top(spark, sf_dir):
    """The flagship: the best documents for a text query."""
    scored = retrieval.lexical(retrieval.build_index(docs(spark, sf_dir)), QUERY)
    return scored.select("id", F.round("lexical", 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)


@register("a3_term_frequency", f"WITH {POSTINGS} SELECT field, token, count(*) AS docs, sum(tf)::BIGINT AS tf FROM postings GROUP BY ALL")
def a3_term_frequency(spark, sf_dir):
    p = retrieval.build_index(docs(spark, sf_dir)).postings
    return p.groupBy("field", "token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@register("a4_document_frequency", f"WITH {POSTINGS} SELECT token, df FROM df")
def a4_document_frequency(spark, sf_dir):
    return retrieval.build_index(docs(spark, sf_dir)).df


@register("a5_corpus_stats", f"WITH {POSTINGS} SELECT docs, round(average, 6) AS average FROM stats")
def a5_corpus_stats(spark, sf_dir):
    return retrieval.build_index(docs(spark, sf_dir)).stats.select("docs", F.round("average", 6).alias("average"))


@register("f3_idf", f"WITH {POSTINGS} SELECT token, round(ln(1 + docs / (1 + df)), 6) AS idf FROM df CROSS JOIN stats")
def f3_idf(spark, sf_dir):
    x = retrieval.build_index(docs(spark, sf_dir))
    return x.df.crossJoin(F.broadcast(x.stats)).select("token", F.round(T.idf(F.col("docs"), F.col("df")), 6).alias("idf"))


@register("f5_bm25", f"WITH {LEXICAL} SELECT id, round(sum(s), 6) AS bm25 FROM (SELECT p.id, ln(1 + docs / (1 + df.df)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * lens.n / average)) AS s FROM postings p JOIN df USING (token) JOIN lens USING (id) CROSS JOIN stats WHERE field = 'body' AND p.token IN ({TERMS})) GROUP BY id")
def f5_bm25(spark, sf_dir):
    x = retrieval.build_index(docs(spark, sf_dir))
    return retrieval.lexical(retrieval.Index(x.postings.where("field = 'body'"), x.df, x.stats, x.lengths), QUERY).select("id", F.round("lexical", 6).alias("bm25"))


@register("g11_lexical", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS lexical, array_to_string(terms, ',') AS terms FROM lex")
def g11_lexical(spark, sf_dir):
    s = retrieval.lexical(retrieval.build_index(docs(spark, sf_dir)), QUERY, docs(spark, sf_dir))
    return s.select("id", F.round("lexical", 6).alias("lexical"), F.array_join("terms", ",").alias("terms"))


WEIGHTS = f"""q AS (SELECT unnest([{TERMS}]) AS term), w AS (SELECT term, ln(1 + docs / (1 + coalesce(df, 0))) AS idf FROM q LEFT JOIN df ON df.token = q.term CROSS JOIN stats),
    weights AS (SELECT term, idf / sum(idf) OVER () AS weight FROM w)"""


@register("z3_query_weights", f"WITH {POSTINGS}, {WEIGHTS} SELECT term, round(weight, 6) AS weight FROM weights")
def z3_query_weights(spark, sf_dir):
    return retrieval.query_weights(retrieval.build_index(docs(spark, sf_dir)), QUERY).select("term", F.round("weight", 6).alias("weight"))


@register("f6_matched_share", f"""WITH {POSTINGS}, {WEIGHTS},
    hit AS (SELECT DISTINCT id, term, weight FROM postings JOIN weights ON token = term OR token = concat(term, 's') OR (term LIKE '%s' AND token = substr(term, 1, length(term) - 1)))
    SELECT docs.id, round(coalesce(sum(weight), 0), 6) AS share FROM docs LEFT JOIN hit ON hit.id = docs.id GROUP BY docs.id""")
def f6_matched_share(spark, sf_dir):
    d = docs(spark, sf_dir)
    return retrieval.matched_share(retrieval.build_index(d), QUERY, d).select("id", F.round("share", 6).alias("share"))


# graph

PICK = "name IN ('part7', 'part11', 'supplier3', 'customer5')"


def _tiers(query: str) -> str:
    """The best tier's nodes for a query without ``#``, lower-cased."""
    tail = "CASE WHEN contains(id, '#') THEN '#' || regexp_replace(regexp_extract(lower(id), '#(.*)$', 1), '~[0-9]+(\\.|$)', '\\1', 'g') ELSE lower(id) END"
    last = query.rsplit(".", 1)[-1]
    dotted = f"""WHEN kind <> 'file' AND lower(name) = '{last}' THEN 3
      WHEN kind = 'file' AND (lower(name) = '{query}' OR lower(path) = '{query}' OR ends_with(lower(path), '/{query}')) THEN 4""" if "." in query else ""
    return f"""SELECT '{query}' AS query, id, tier FROM (SELECT id, tier, min(tier) OVER () AS best FROM (
      SELECT id, CASE WHEN kind <> 'file' AND (lower(name) = '{query}' OR ends_with({tail}, '#{query}') OR ends_with({tail}, '.{query}')) THEN 2 {dotted} END AS tier FROM nodes) WHERE tier IS NOT NULL) WHERE tier = best"""


ASKED = ("part7", "x.part11", "supplier3")


@register("g1_resolve_symbol", " UNION ALL ".join(map(_tiers, ASKED)) + " UNION ALL SELECT 'id' AS query, id, 1 AS tier FROM nodes WHERE id = (SELECT min(id) FROM nodes WHERE contains(id, '#'))")
def g1_resolve_symbol(spark, sf_dir):
    nodes = view(spark, sf_dir, "nodes")
    one = nodes.where(F.contains("id", F.lit("#"))).agg(F.min("id")).first()[0]
    found = [graph.resolve_symbol(nodes, query).select(F.lit(label).alias("query"), "id", "tier") for query, label in (*((q.replace("part", "Part"), q) for q in ASKED), (one, "id"))]
    return reduce(DataFrame.unionByName, found)


def _hop(near: str, far: str) -> str:
    return f"""SELECT DISTINCT e.{near} AS subject, e.{far} AS id, relation, coalesce(n.name, e.{far}) AS name, n.path AS path
    FROM edges e JOIN nodes s ON s.id = e.{near} LEFT JOIN nodes n ON n.id = e.{far} WHERE relation IN {WALK} AND s.{PICK}"""


@register("g2_callers", _hop("target", "source"))
def g2_callers(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.callers(n, e, n.where(PICK))


@register("g3_callees", _hop("source", "target").replace(PICK, "name IN ('order1', 'order3', 'order32', 'order100')"))
def g3_callees(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.callees(n, e, n.where("name IN ('order1', 'order3', 'order32', 'order100')"))


def _walk(near: str, far: str, depth: int, pick: str) -> str:
    return f"""WITH steps AS (SELECT DISTINCT {near} AS near, {far} AS far, relation FROM edges WHERE relation IN {WALK}),
    hops AS (SELECT id, 0 AS depth, '' AS relation FROM nodes WHERE {pick} UNION SELECT far, depth + 1, steps.relation FROM hops JOIN steps ON near = hops.id WHERE depth < {depth}),
    least AS (SELECT id, min(depth) AS d FROM hops GROUP BY id)
    SELECT h.id, d::INT AS depth, min(relation) AS relation FROM hops h JOIN least l ON l.id = h.id AND h.depth = l.d WHERE d > 0 GROUP BY h.id, d"""


@register("g4_walk_in", _walk("target", "source", 3, PICK))
def g4_walk_in(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.walk(e, n.where(PICK), 3, "in")


@register("g5_walk_out", _walk("source", "target", 2, "name = 'order7'"))
def g5_walk_out(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.walk(e, n.where("name = 'order7'"), 2, "out")


@register("g7_closure", _walk("source", "target", 9, "path = 'sales/O/1'"))
def g7_closure(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.walk(e, graph.file_seeds(n, "sales/O/1"), None, "out")


SEEDS = "SELECT id, CAST(length(name) AS DOUBLE) AS weight FROM nodes WHERE name IN ('part3', 'part5', 'customer1', 'customer8', 'supplier2')"
RANKS = f"""ends AS (SELECT source, target FROM edges WHERE relation IN {WALK} AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
    both_ways AS (SELECT source, target FROM ends UNION ALL SELECT target, source FROM ends),
    step AS MATERIALIZED (SELECT source, target, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS p FROM both_ways GROUP BY source, target),
    start AS MATERIALIZED (SELECT id, weight / sum(weight) OVER () AS r FROM ({SEEDS})),
    move AS MATERIALIZED (SELECT source, target, 0.75 * p AS p FROM step UNION ALL SELECT s.source, start.id, 0.25 * r FROM (SELECT DISTINCT source FROM step) s CROSS JOIN start
      UNION ALL SELECT s.id, start.id, start.r FROM start s CROSS JOIN start WHERE s.id NOT IN (SELECT source FROM step)),
    walk AS (SELECT 0 AS i, id, r AS mass FROM start UNION ALL SELECT i + 1, target, sum(mass * p) FROM walk JOIN move ON source = id WHERE i < 25 GROUP BY i, target),
    ranks AS (SELECT id, mass / max(mass) OVER () AS rank FROM walk WHERE i = 25)"""


@register("g8_pagerank", f"WITH {RANKS} SELECT id, round(rank, 6) AS rank FROM ranks")
def g8_pagerank(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    seeds = n.where("name IN ('part3', 'part5', 'customer1', 'customer8', 'supplier2')").select("id", F.length("name").cast("double").alias("weight"))
    return graph.personalized_pagerank(n, e, seeds).select("id", F.round("rank", 6).alias("rank"))


@register("g12_hybrid", f"""WITH {RANKS}, lex AS (SELECT id, weight AS lexical FROM ({SEEDS})),
    c AS (SELECT coalesce(l.id, r.id) AS id, coalesce(lexical / (SELECT max(lexical) FROM lex), 0) AS lexical, coalesce(rank, 0) AS graph FROM lex l FULL JOIN ranks r ON r.id = l.id WHERE l.id IS NOT NULL OR rank >= 0.15)
    SELECT c.id, round(lexical, 6) AS lexical, round(graph, 6) AS graph, round((lexical + 0.5 * graph) * CASE WHEN path LIKE '%/tests/%' THEN 0.35 ELSE 1 END, 6) AS score FROM c JOIN nodes n ON n.id = c.id""")
def g12_hybrid(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    seeds = n.where("name IN ('part3', 'part5', 'customer1', 'customer8', 'supplier2')").select("id", F.length("name").cast("double").alias("weight"))
    ranks = graph.personalized_pagerank(n, e, seeds)
    out = retrieval.blend(seeds.withColumnRenamed("weight", "lexical"), ranks, n.select("id", T.test_factor(F.col("path")).alias("factor")))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("lexical", "graph", "score")])


@register("g10_structural", f"""SELECT e.source AS id, e.relation, coalesce(n.name, e.source) AS name FROM edges e LEFT JOIN nodes n ON n.id = e.source
    WHERE e.target IN (SELECT id FROM nodes WHERE name = 'supplier3') AND relation IN {graph.INCOMING_RELATIONS} GROUP BY e.source, e.relation, n.name, n.path ORDER BY coalesce(n.path, e.source), e.source, e.relation LIMIT 30""")
def g10_structural(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.structural(n, e, "who calls supplier3", 30)[1].select("id", "relation", "name")


DEGREE = f"deg AS (SELECT target AS id, count(*) AS degree FROM edges WHERE relation IN {WALK} GROUP BY target)"


@register("a1_in_degree", f"WITH {DEGREE} SELECT id, degree FROM deg")
def a1_in_degree(spark, sf_dir):
    return graph.in_degree(view(spark, sf_dir, "edges"))


@register("a2_in_degree_all", "SELECT target AS id, count(*) AS degree FROM edges GROUP BY target")
def a2_in_degree_all(spark, sf_dir):
    return graph.in_degree(view(spark, sf_dir, "edges"), None)


@register("a6_counts", "SELECT 'kind' AS what, kind AS value, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation")
def a6_counts(spark, sf_dir):
    return graph.counts(*nodes_edges(spark, sf_dir))


@register("a7_quality", f"""WITH e AS (SELECT count(*) AS edges, sum((source = target)::INT)::BIGINT AS self_loops, sum((target NOT IN (SELECT id FROM nodes))::INT)::BIGINT AS external FROM edges),
    t AS (SELECT source AS id FROM edges WHERE relation IN {WALK} UNION SELECT target FROM edges WHERE relation IN {WALK}),
    s AS (SELECT count(*) AS symbols, sum((id NOT IN (SELECT id FROM t))::INT)::BIGINT AS orphans FROM nodes WHERE kind <> 'file')
    SELECT *, round(100.0 * orphans / symbols, 2)::DOUBLE AS orphan_percent FROM e CROSS JOIN s""")
def a7_quality(spark, sf_dir):
    return graph.quality_report(*nodes_edges(spark, sf_dir))


BROKEN = """broken_nodes AS (SELECT id, CASE WHEN name = 'part9' THEN '' ELSE name END AS name, CASE WHEN name = 'part10' THEN 'widget' ELSE kind END AS kind FROM nodes WHERE name <> 'supplier1' UNION ALL SELECT id, name, kind FROM nodes WHERE name IN ('part12', 'nation3')),
    broken_edges AS (SELECT source, target, CASE WHEN relation = 'extends' THEN 'inherits' ELSE relation END AS relation FROM edges)"""


@register("a8_invariants", f"""WITH {BROKEN}
    SELECT 'duplicate_id' AS rule, id FROM broken_nodes GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'empty_name', id FROM broken_nodes WHERE name = '' UNION ALL SELECT 'unknown_kind', id FROM broken_nodes WHERE kind = 'widget'
    UNION ALL SELECT 'unknown_relation', source FROM broken_edges WHERE relation = 'inherits'
    UNION ALL SELECT DISTINCT 'dangling_source', source FROM broken_edges WHERE source NOT IN (SELECT id FROM broken_nodes)
    UNION ALL SELECT DISTINCT 'dangling_target', target FROM broken_edges WHERE relation <> 'imports' AND target NOT IN (SELECT id FROM broken_nodes)""")
def a8_invariants(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    broken = n.where("name <> 'supplier1'").unionByName(n.where("name IN ('part12', 'nation3')"))
    named = n.where("name <> 'supplier1'").select("id", F.when(F.col("name") == "part9", "").otherwise(F.col("name")).alias("name"), F.when(F.col("name") == "part10", "widget").otherwise(F.col("kind")).alias("kind"))
    named = named.unionByName(broken.where("name IN ('part12', 'nation3')").select("id", "name", "kind").distinct())
    return graph.violations(named, e.withColumn("relation", F.when(F.col("relation") == "extends", "inherits").otherwise(F.col("relation"))))


@register("g21_repo_map", f"""WITH {DEGREE}, files AS (SELECT split_part(path, '/', 1) AS seg, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY 1),
    keyed AS (SELECT n.*, CASE WHEN f.n > 0.6 * (SELECT sum(n) FROM files) THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE seg END AS dir FROM nodes n JOIN files f ON f.seg = split_part(path, '/', 1)),
    hub AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY degree DESC, name, path) AS place FROM keyed JOIN deg USING (id) WHERE kind <> 'file'),
    hubs AS (SELECT dir, string_agg(name, ',' ORDER BY place) AS hubs FROM hub WHERE place <= 3 GROUP BY dir)
    SELECT dir, sum((kind = 'file')::INT)::BIGINT AS files, sum((kind <> 'file')::INT)::BIGINT AS symbols, coalesce(string_agg(DISTINCT CASE WHEN kind = 'file' THEN language END, ',' ORDER BY CASE WHEN kind = 'file' THEN language END), '') AS languages, coalesce(max(hubs), '') AS hubs
    FROM keyed LEFT JOIN hubs USING (dir) GROUP BY dir ORDER BY symbols DESC, dir LIMIT 16""")
def g21_repo_map(spark, sf_dir):
    return graph.repo_map(*nodes_edges(spark, sf_dir))


@register("k2_top_hubs", f"WITH {DEGREE} SELECT id, name, degree FROM nodes JOIN deg USING (id) WHERE kind <> 'file' ORDER BY degree DESC, name, path LIMIT 25")
def k2_top_hubs(spark, sf_dir):
    return graph.top_hubs(*nodes_edges(spark, sf_dir), 25).select("id", "name", "degree")


@register("u2_union_edges", "SELECT source, relation, target, min(confidence) AS confidence FROM (SELECT source, relation, target, 'extracted' AS confidence FROM edges WHERE relation <> 'calls' UNION ALL SELECT source, relation, target, 'inferred' FROM edges) GROUP BY ALL")
def u2_union_edges(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return graph.union_edges(e.where("relation <> 'calls'").withColumn("confidence", F.lit("extracted")), e.withColumn("confidence", F.lit("inferred")))


@register("z1_descendants", "SELECT source AS id, count(*) AS n FROM edges WHERE relation = 'contains' GROUP BY source")
def z1_descendants(spark, sf_dir):
    return graph.descendants(view(spark, sf_dir, "edges"))


@register("z2_known_edges", "SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def z2_known_edges(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    ids = n.select("id")
    return e.join(ids, e.source == ids.id, "left_semi").join(ids, e.target == ids.id, "left_semi")


# intervals and search

LINES = "lines AS (SELECT path, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1)::INT AS line FROM docs)"
HITS = f"{LINES}, hits AS (SELECT path, line FROM lines WHERE regexp_matches(text, 'th(e|an)r[aeiou]'))"


@register("p8_grep_lines", f"WITH {HITS} SELECT path, line FROM hits")
def p8_grep_lines(spark, sf_dir):
    return intervals.matching_lines(docs(spark, sf_dir), "th(e|an)r[aeiou]").select("path", "line")


@register("j4_innermost_span", f"WITH {HITS}, best AS (SELECT h.path, h.line, id, row_number() OVER (PARTITION BY h.path, h.line ORDER BY span_start DESC, id DESC) AS n FROM hits h LEFT JOIN spans s ON s.path = h.path AND line BETWEEN span_start AND span_end) SELECT path, line, id FROM best WHERE n = 1")
def j4_innermost_span(spark, sf_dir):
    return intervals.innermost(intervals.matching_lines(docs(spark, sf_dir), "th(e|an)r[aeiou]").select("path", "line"), view(spark, sf_dir, "spans"))


@register("j6_smallest_span", f"WITH {HITS}, best AS (SELECT h.path, h.line, id, row_number() OVER (PARTITION BY h.path, h.line ORDER BY span_end - span_start, id DESC) AS n FROM hits h LEFT JOIN spans s ON s.path = h.path AND line BETWEEN span_start AND span_end) SELECT path, line, id FROM best WHERE n = 1")
def j6_smallest_span(spark, sf_dir):
    return intervals.innermost(intervals.matching_lines(docs(spark, sf_dir), "th(e|an)r[aeiou]").select("path", "line"), view(spark, sf_dir, "spans"), "width")


TOUCHED = """ov AS (SELECT DISTINCT c.path, range_start, range_end, id, span_start, span_end FROM changes c JOIN spans s ON s.path = c.path AND span_start <= range_end AND span_end >= range_start),
    touched AS (SELECT DISTINCT path, id FROM ov a WHERE NOT EXISTS (SELECT 1 FROM ov b WHERE b.path = a.path AND b.range_start = a.range_start AND b.range_end = a.range_end AND b.id <> a.id AND b.span_start >= a.span_start AND b.span_end <= a.span_end))"""


@register("j5_changed_symbols", f"WITH {TOUCHED} SELECT path, id FROM touched")
def j5_changed_symbols(spark, sf_dir):
    return intervals.changed_symbols(view(spark, sf_dir, "changes"), view(spark, sf_dir, "spans"))


@register("p13_range_overlap", f"WITH {TOUCHED} SELECT path, range_start, range_end, id FROM ov")
def p13_range_overlap(spark, sf_dir):
    return intervals.overlapping(view(spark, sf_dir, "changes"), view(spark, sf_dir, "spans")).select("path", "range_start", "range_end", "id")


@register("g20_search", f"""WITH {HITS}, capped AS (SELECT * FROM hits ORDER BY path, line LIMIT 300), best AS (SELECT h.path, h.line, id, row_number() OVER (PARTITION BY h.path, h.line ORDER BY span_start DESC, id DESC) AS n FROM capped h LEFT JOIN spans s ON s.path = h.path AND line BETWEEN span_start AND span_end)
    SELECT path, id, count(*) AS lines, min(line)::INT AS first_line FROM best WHERE n = 1 GROUP BY path, id""")
def g20_search(spark, sf_dir):
    return intervals.search(docs(spark, sf_dir), view(spark, sf_dir, "spans"), None, "th(e|an)r[aeiou]").drop("degree")


@register("w10_overflow", f"WITH {HITS} SELECT least(count(*), 300)::BIGINT AS kept, greatest(count(*) - 300, 0)::BIGINT AS dropped FROM hits")
def w10_overflow(spark, sf_dir):
    return intervals.overflow(intervals.matching_lines(docs(spark, sf_dir), "th(e|an)r[aeiou]"), [], 300)


@register("f27_residual_lines", f"WITH {LINES} SELECT path, line, text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = l.path AND line BETWEEN span_start AND span_end)")
def f27_residual_lines(spark, sf_dir):
    return intervals.residual_lines(docs(spark, sf_dir), view(spark, sf_dir, "spans")).select("path", "line", "text")


# drift

def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", F.sha2("text", 256))


STATE = "CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN sha256(a.text) <> sha256(b.text) THEN 'changed' ELSE 'same' END"


@register("j8_drift", f"SELECT coalesce(a.id, b.id) AS id, {STATE} AS state FROM committed a FULL JOIN current_files b ON a.id = b.id")
def j8_drift(spark, sf_dir):
    return drift.drift(hashed(view(spark, sf_dir, "committed")), hashed(view(spark, sf_dir, "current_files")))


@register("g28_drift_counts", f"WITH s AS (SELECT {STATE} AS state FROM committed a FULL JOIN current_files b ON a.id = b.id) SELECT sum((state = 'added')::INT)::BIGINT AS added, sum((state = 'removed')::INT)::BIGINT AS removed, sum((state = 'changed')::INT)::BIGINT AS changed, sum((state = 'same')::INT)::BIGINT AS same FROM s")
def g28_drift_counts(spark, sf_dir):
    return drift.freshness(drift.drift(hashed(view(spark, sf_dir, "committed")), hashed(view(spark, sf_dir, "current_files"))))


@register("j9_file_drift", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size = b.size AND a.size % 10 = b.size % 10 THEN 'same' WHEN sha256(a.text) <> sha256(b.text) THEN 'changed' ELSE 'touched' END AS state FROM committed a FULL JOIN current_files b ON a.path = b.path")
def j9_file_drift(spark, sf_dir):
    stamp = lambda name: hashed(view(spark, sf_dir, name)).withColumn("mtime", F.col("size") % 10)
    return drift.file_drift(stamp("committed"), stamp("current_files"))


@register("j11_carry_over", "SELECT b.id, CASE WHEN summary_state = 'ready' AND sha256(a.text) = sha256(b.text) THEN 'ready' WHEN summary_state = 'ready' THEN 'stale' ELSE 'pending' END AS summary_state, coalesce(summary_state = 'ready' AND sha256(a.text) = sha256(b.text), false) AS reused FROM current_files b LEFT JOIN committed a ON a.id = b.id")
def j11_carry_over(spark, sf_dir):
    return drift.carry_over(hashed(view(spark, sf_dir, "current_files")), hashed(view(spark, sf_dir, "committed")))


@register("a27_digest", "SELECT name, sha256(string_agg(concat(path, ':', sha256(body)), chr(10) ORDER BY concat(path, ':', sha256(body)))) AS digest FROM docs GROUP BY name")
def a27_digest(spark, sf_dir):
    return drift.digest(docs(spark, sf_dir).withColumn("hash", F.sha2("body", 256)), "name")


@register("j12_savings", "SELECT count(*) AS files, floor(coalesce(sum(chars), 0) / 4.0 + 0.5)::BIGINT AS baseline_tokens, greatest(floor(coalesce(sum(chars), 0) / 4.0 + 0.5) - 120, 0)::BIGINT AS saved_tokens FROM nodes WHERE kind = 'file' AND path IN (SELECT path FROM nodes WHERE name LIKE 'part1%')")
def j12_savings(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    return drift.savings(n.where("name LIKE 'part1%'"), n.where("kind = 'file'"), F.lit(120))


# ranking windows and fusion

def scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


GATE = "best AS (SELECT scope, max(score) AS best FROM scored WHERE score > 0 GROUP BY scope), part AS (SELECT * FROM best WHERE best >= 0.25 * (SELECT max(best) FROM best))"


@register("g15_fuse_ranks", f"""WITH {GATE}, placed AS (SELECT id, scope, score, best, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS place FROM scored JOIN part USING (scope) WHERE score > 0),
    f AS (SELECT id, sum(1.0::DOUBLE / (60 + place)) AS rrf, first(scope ORDER BY place, best DESC, scope) AS scope FROM placed GROUP BY id) SELECT id, scope, round(rrf / max(rrf) OVER (), 6) AS score FROM f""")
def g15_fuse_ranks(spark, sf_dir):
    return retrieval.fuse_ranks(scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("g16_combine_scores", f"""WITH {GATE}, f AS (SELECT id, max(score) AS own, first(scope ORDER BY score DESC, best DESC, scope) AS scope FROM scored JOIN part USING (scope) WHERE score > 0 GROUP BY id) SELECT id, scope, round(own / max(own) OVER (), 6) AS score FROM f""")
def g16_combine_scores(spark, sf_dir):
    return retrieval.combine_scores(scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("w1_rank_in_scope", "SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS place FROM scored")
def w1_rank_in_scope(spark, sf_dir):
    from pyspark.sql.window import Window

    return scored(spark, sf_dir).select("id", "scope", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("score").desc(), "id")).cast("bigint").alias("place"))


@register("w2_round_robin", """WITH p AS (SELECT id, scope, row_number() OVER (ORDER BY score DESC, scope, id) AS place FROM scored),
    d AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY place) AS depth, min(place) OVER (PARTITION BY scope) AS lead FROM p)
    SELECT id, scope, row_number() OVER (ORDER BY depth, lead) AS position FROM d ORDER BY depth, lead LIMIT 40""")
def w2_round_robin(spark, sf_dir):
    placed = scored(spark, sf_dir).withColumn("place", F.struct((-F.col("score")).alias("s"), "scope", "id"))
    return retrieval.round_robin(placed, "scope", "place", 40).select("id", "scope", F.col("position").cast("bigint").alias("position"))


@register("w4_max_normalised", "SELECT id, scope, round(score / max(score) OVER (PARTITION BY scope), 6) AS score FROM scored")
def w4_max_normalised(spark, sf_dir):
    s = scored(spark, sf_dir)
    top = s.groupBy("scope").agg(F.max("score").alias("top"))
    return s.join(top, "scope").select("id", "scope", F.round(F.col("score") / F.col("top"), 6).alias("score"))


@register("g13_rank_files", f"""WITH {LEXICAL}, {WEIGHTS},
    cand AS (SELECT l.id, d.name AS file, lexical AS raw, lexical / (SELECT max(lexical) FROM lex) AS lexical, (d.doc_id % 10) / 20.0::DOUBLE AS graph, terms FROM lex l JOIN docs d ON d.id = l.id),
    c2 AS (SELECT *, lexical + 0.5 * graph AS baseline, (SELECT least(1, sum(weight)) FROM weights WHERE list_contains(terms, term)) AS coverage FROM cand),
    anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY raw DESC, coverage DESC, id) AS n FROM c2) WHERE n = 1),
    un AS (SELECT file, least(1, sum(weight)) AS u FROM (SELECT DISTINCT file, unnest(terms) AS term FROM c2) JOIN weights USING (term) GROUP BY file),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY baseline DESC, raw DESC, id) AS n FROM c2) WHERE n = 1),
    j AS (SELECT b.file, b.id, b.baseline, a.id AS aid, a.lexical AS al, least(1, a.graph) AS ag, a.coverage AS ac, u, least(1, greatest(0, a.coverage * greatest(0, u - a.coverage) / u)) AS residual FROM best b JOIN anchor a USING (file) JOIN un USING (file)),
    k AS (SELECT *, least(1, al + (1 - al) * residual) + 0.5 * ag AS pooled FROM j)
    SELECT file, CASE WHEN round(pooled, 9) > round(baseline, 9) THEN aid ELSE id END AS representative, round(greatest(pooled, baseline), 6) AS score, round(u, 6) AS union_coverage, round(residual, 6) AS residual FROM k""")
def g13_rank_files(spark, sf_dir):
    d = docs(spark, sf_dir)
    x = retrieval.build_index(d)
    lex = retrieval.lexical(x, QUERY)
    top = lex.agg(F.max("lexical").alias("top"))
    cand = lex.crossJoin(F.broadcast(top)).join(d.select("id", F.col("name").alias("file"), "doc_id"), "id")
    cand = cand.select("id", "file", F.lit("symbol").alias("kind"), F.col("lexical").alias("raw_lexical"), (F.col("lexical") / F.col("top")).alias("lexical"), ((F.col("doc_id") % 10) / 20.0).alias("graph"), F.lit(1.0).alias("factor"), "terms", F.lit(True).alias("eligible"))
    cand = cand.withColumn("baseline", F.round(F.col("lexical") + 0.5 * F.col("graph"), 9))
    weights = retrieval.query_weights(x, QUERY).select("term", "weight")
    out = retrieval.rank_files(cand, weights)
    return out.select("file", "representative", F.round("score", 6).alias("score"), F.round("union_coverage", 6).alias("union_coverage"), F.round("residual", 6).alias("residual"))


# ownership and impact

NOW = "2024-02-01"
OWNERS = f"""once AS (SELECT area, author, hash, min(pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(made_at)) / 86400.0 / 120.0)) AS weight FROM commits GROUP BY ALL),
    sums AS (SELECT area, author, count(*) AS commits, round(sum(weight), 6) AS score FROM once GROUP BY ALL),
    shares AS (SELECT *, round(score / sum(score) OVER (PARTITION BY area), 6) AS share, row_number() OVER (PARTITION BY area ORDER BY score DESC, commits DESC, author) AS place FROM sums)"""


@register("a17_ownership", f"WITH {OWNERS} SELECT area, author, commits, score, share FROM shares WHERE place <= 3")
def a17_ownership(spark, sf_dir):
    from pyspark.sql.window import Window

    c = view(spark, sf_dir, "commits")
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("made_at").cast("timestamp").cast("double")) / 86400.0
    once = c.groupBy("area", "author", "hash").agg(F.min(T.decay(age, impact.HALF_LIFE)).alias("weight"))
    sums = once.groupBy("area", "author").agg(F.count("*").alias("commits"), F.round(F.sum("weight"), 6).alias("score"))
    shares = sums.withColumn("share", F.round(F.col("score") / F.sum("score").over(Window.partitionBy("area")), 6))
    place = F.row_number().over(Window.partitionBy("area").orderBy(F.col("score").desc(), F.col("commits").desc(), "author"))
    return shares.withColumn("place", place).where("place <= 3").drop("place")


FEW = "few AS (SELECT hash, made_at, concat('user', CAST(substr(author, 5) AS BIGINT) % 5) AS author, area FROM commits)"
FEW_OWNERS = f"{FEW}, " + OWNERS.replace("FROM commits", "FROM few")


def few(spark, sf_dir):
    user = F.concat(F.lit("user"), (F.substring("author", 5, 99).cast("bigint") % 5).cast("string"))
    return view(spark, sf_dir, "commits").select("hash", "made_at", user.alias("author"), F.concat(user, F.lit("@x.org")).alias("email"), "area")


@register("a17_owners", f"WITH {FEW_OWNERS} SELECT area, author, commits, score, share, place FROM shares WHERE share >= 0.15 AND place <= 2")
def a17_owners(spark, sf_dir):
    return impact.owners(few(spark, sf_dir), F.lit(NOW)).withColumn("place", F.col("place").cast("bigint"))


@register("a18_reviewers", f"""WITH {FEW_OWNERS}, o AS (SELECT * FROM shares WHERE share >= 0.15 AND place <= 2), r AS (SELECT author, round(sum(score * CASE WHEN area < 'm' THEN 1 ELSE 0.6 END), 6) AS weighted, sum(commits)::BIGINT AS commits, count(*) AS areas FROM o GROUP BY author)
    SELECT * FROM r ORDER BY weighted DESC, commits DESC, author LIMIT 3""")
def a18_reviewers(spark, sf_dir):
    o = impact.owners(few(spark, sf_dir), F.lit(NOW))
    return impact.reviewers(o.where("area < 'm'").select("author", "score", "commits"), o.where("area >= 'm'").select("author", "score", "commits"))


CHANGED = "changed AS (SELECT DISTINCT path FROM nodes WHERE path IN ('catalog/Brand#13/7', 'catalog/Brand#22/11', 'supply/s2', 'crm/BUILDING/tests/case') OR path LIKE 'geo/ASIA%' OR path LIKE 'catalog/%/3')"
BLAST = f"""{CHANGED}, seed AS (SELECT n.path AS origin, n.id FROM nodes n JOIN changed USING (path) WHERE n.kind <> 'file'),
    steps AS (SELECT DISTINCT target AS near, source AS far FROM edges WHERE relation IN {WALK}),
    hops AS (SELECT origin, id, 0 AS depth FROM seed UNION SELECT origin, far, depth + 1 FROM hops JOIN steps ON near = hops.id WHERE depth < 2),
    least AS (SELECT origin, id, min(depth) AS depth FROM hops GROUP BY ALL),
    impacted AS (SELECT id, min(depth)::INT AS depth, list_sort(list_distinct(list(origin))) AS origins FROM least WHERE depth > 0 GROUP BY id)"""


def changed_paths(n: DataFrame) -> DataFrame:
    return n.where("path IN ('catalog/Brand#13/7', 'catalog/Brand#22/11', 'supply/s2', 'crm/BUILDING/tests/case') OR path LIKE 'geo/ASIA%' OR path LIKE 'catalog/%/3'").select("path").distinct()


def blasted(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    changed = changed_paths(n)
    seeds = n.where("kind <> 'file'").join(changed, "path").select(F.col("path").alias("origin"), "id")
    return n, e, changed, seeds, impact.blast(e, seeds, 2)


@register("g22_blast_radius", f"WITH {BLAST} SELECT id, depth, array_to_string(origins, ',') AS origins FROM impacted")
def g22_blast_radius(spark, sf_dir):
    return blasted(spark, sf_dir)[4].withColumn("origins", F.array_join("origins", ","))


@register("a13_modules", f"""WITH {BLAST}, hit AS (SELECT i.*, n.path, regexp_replace(n.path, '/[^/]*$', '') AS module FROM impacted i JOIN nodes n USING (id) WHERE n.path NOT IN (SELECT path FROM changed)),
    f AS (SELECT module, count(DISTINCT o) AS origins FROM (SELECT module, unnest(origins) AS o FROM hit) GROUP BY module)
    SELECT module, count(*) AS symbols, count(DISTINCT path) AS files, max(f.origins) AS origins FROM hit JOIN f USING (module) GROUP BY module""")
def a13_modules(spark, sf_dir):
    n, _, changed, _, hit = blasted(spark, sf_dir)
    return impact.modules(hit, n, changed)


@register("a14_areas", f"""WITH {CHANGED}, t AS (SELECT DISTINCT e.target AS id, n.path AS test FROM edges e JOIN nodes n ON n.id = e.source WHERE n.path LIKE '%/tests/%'),
    sig AS (SELECT id, count(*) AS n, sum((test IN (SELECT path FROM changed))::INT) AS c FROM t GROUP BY id),
    s AS (SELECT n.*, coalesce(sig.n, 0) AS n, coalesce(sig.c, 0) AS c FROM nodes n JOIN changed USING (path) LEFT JOIN sig USING (id) WHERE n.kind <> 'file' AND n.path NOT LIKE '%/tests/%')
    SELECT regexp_replace(path, '/[^/]*$', '') AS area, count(DISTINCT path) AS files, count(*) AS seeds, sum((kind IN ('function', 'method', 'class'))::INT)::BIGINT AS behavioural, sum((kind IN ('function', 'method', 'class') AND n > 0)::INT)::BIGINT AS reached,
      CASE WHEN sum((kind IN ('function', 'method', 'class'))::INT) = 0 THEN 'na' WHEN sum(c) > 0 THEN 'changed' WHEN sum(n) > 0 THEN 'stale' ELSE 'none' END AS tests FROM s GROUP BY 1""")
def a14_areas(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    changed = changed_paths(n)
    return impact.areas(n.where("kind <> 'file'").join(changed, "path"), n, e, changed)


@register("j19_smallest_claim", "WITH claim AS (SELECT DISTINCT source AS concept, path FROM docs UNION SELECT scope, path FROM docs), n AS (SELECT concept, count(*) AS n FROM claim GROUP BY concept) SELECT path, first(concept ORDER BY n, concept) AS concept FROM claim JOIN n USING (concept) GROUP BY path")
def j19_smallest_claim(spark, sf_dir):
    d = docs(spark, sf_dir)
    return impact.smallest_claim(d.select(F.col("source").alias("concept"), "path").union(d.select("scope", "path")).distinct())


@register("a16_unanimity", "SELECT source, CASE WHEN count(DISTINCT concept) = 1 AND count(concept) = count(*) THEN min(concept) END AS concept FROM (SELECT source, CASE WHEN source LIKE '%1' THEN 'one' ELSE scope END AS concept FROM docs) GROUP BY source")
def a16_unanimity(spark, sf_dir):
    concept = F.when(F.col("source").endswith("1"), "one").otherwise(F.col("scope"))
    return impact.shared_concept(docs(spark, sf_dir).withColumn("concept", concept), "source", "concept")


@register("j20_outside_dependents", "SELECT source, target, relation FROM edges WHERE target IN (SELECT id FROM nodes WHERE path = 'supply/s2') AND source NOT IN (SELECT id FROM nodes WHERE path = 'supply/s2')")
def j20_outside_dependents(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return impact.outside_dependents(e, n, "supply/s2")


@register("j21_test_edges", "SELECT e.target AS id, count(DISTINCT n.path) AS tests FROM edges e JOIN nodes n ON n.id = e.source WHERE n.path LIKE '%/tests/%' GROUP BY e.target")
def j21_test_edges(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return impact.test_edges(e, n)
