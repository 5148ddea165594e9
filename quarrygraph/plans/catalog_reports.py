"""Queries of the report, evidence and upkeep operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygraph.operators import impact, reports
from quarrygraph.plans.catalog import BLAST, SEEDS, WALK, blasted, docs, nodes_edges, register, scalars
from quarrygraph.plans.views import view

scalars("f20_error_class", "docs", {"error": (lambda: reports.error_class(F.when(F.col("doc_id") % 5 == 0, "EPERM").when(F.col("doc_id") % 5 == 1, "ENOTFOUND"), F.when(F.col("doc_id") % 3 == 0, 429).when(F.col("doc_id") % 3 == 1, 503), F.concat(F.lit("cannot LOCK "), F.col("path"))), "CASE WHEN doc_id % 5 = 0 THEN 'E_PERMISSION' WHEN doc_id % 5 = 1 THEN 'E_NETWORK' WHEN doc_id % 3 = 0 THEN 'E_RATE_LIMIT' WHEN doc_id % 3 = 1 THEN 'E_LLM' ELSE 'E_LOCK' END")})
scalars("f33_prefix_pointers", "docs", {"pointers": (lambda: reports.prefixed_pointers(F.col("source"), F.concat("path", F.lit(", two words,"), F.col("scope"))), "concat(source, '/', path, ',  two words, ', source, '/', scope)")})
scalars("f35_shift_span", "spans", {"span": (lambda: reports.shifted_span(F.concat(F.lit("L"), F.col("span_start").cast("string"), F.lit("-L"), F.col("span_end").cast("string")), F.lit(10)), "concat('L', span_start + 10, '-L', span_end + 10)")}, "id")
scalars("f15_clean_label", "docs", {"label": (lambda: reports.clean_label(F.concat(F.lit("<"), F.substring("source", 1, 20), F.lit("|>\n(x)"))), "concat(source, ' x')")})
scalars("p20_stale_rules", "commits", {"stale": (lambda: reports.rules_stale(F.col("made_at"), F.lit("2024-01-15"), F.hour("made_at") % 2), "epoch(TIMESTAMP '2024-01-15') - epoch(made_at) > CASE WHEN hour(made_at) % 2 = 0 THEN 120 ELSE 21600 END")}, "hash")
scalars("z5_crux_span", "spans", {
    "lo": (lambda: reports.crux_span(F.col("span_start"), F.col("span_end"), F.col("span_start") + 2, F.col("span_start") + 40)["start"].cast("bigint"), "least(span_start + 2, span_end)::BIGINT"),
    "hi": (lambda: reports.crux_span(F.col("span_start"), F.col("span_end"), F.col("span_start") + 2, F.col("span_start") + 40)["end"].cast("bigint"), "least(span_end, span_start + 13)::BIGINT"),
}, "id")


@register("p21_relevance", "WITH h AS (SELECT source AS session, path AS pointer, doc_id AS place, (doc_id % 7) / 10.0 AS strong, (doc_id % 11) / 12.0 AS broad FROM docs), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place) AS n FROM h WHERE (strong >= 0.1 OR broad >= 0.5) AND place % 4 <> 0) SELECT session, pointer FROM o WHERE n <= 3")
def p21_relevance(spark, sf_dir):
    h = docs(spark, sf_dir).select(F.col("source").alias("session"), F.col("path").alias("pointer"), F.col("doc_id").alias("place"), ((F.col("doc_id") % 7) / 10.0).alias("strong"), ((F.col("doc_id") % 11) / 12.0).alias("broad"))
    seen = h.where("place % 4 = 0").select("session", "pointer")
    return reports.relevant(h, seen, F.round("strong", 6), F.round("broad", 6)).select("session", "pointer")


@register("w5_ordinals", "SELECT path, CASE WHEN n = 1 THEN source ELSE concat(source, '~', n) END AS id FROM (SELECT path, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs)")
def w5_ordinals(spark, sf_dir):
    return reports.duplicate_ordinals(docs(spark, sf_dir).select("path", "source", "doc_id"), "source", "doc_id").select("path", "id")


@register("z10_capped_dependents", f"SELECT target AS id, least(count(*), 8)::BIGINT AS shown, greatest(count(*) - 8, 0)::BIGINT AS more FROM edges WHERE relation IN {WALK} GROUP BY target")
def z10_capped_dependents(spark, sf_dir):
    e = view(spark, sf_dir, "edges").where(F.col("relation") != "contains")
    return reports.capped_with_rest(e.withColumnRenamed("target", "id"), "id", [F.col("source")], 8)


@register("z7_impact_table", f"""WITH {BLAST}, m AS (SELECT regexp_replace(n.path, '/[^/]*$', '') AS module, count(*) AS symbols, count(DISTINCT n.path) AS files, row_number() OVER (ORDER BY count(*) DESC, regexp_replace(n.path, '/[^/]*$', '')) AS k FROM impacted i JOIN nodes n USING (id) WHERE n.path NOT IN (SELECT path FROM changed) GROUP BY 1)
    SELECT CASE WHEN k <= 3 THEN module ELSE '(smaller)' END AS module, sum(symbols)::BIGINT AS symbols, sum(files)::BIGINT AS files FROM m GROUP BY 1""")
def z7_impact_table(spark, sf_dir):
    n, _, changed, _, hit = blasted(spark, sf_dir)
    return reports.impact_table(impact.modules(hit, n, changed), 3)


@register("z14_live_pages", "WITH l AS (SELECT area AS key, max(made_at) AS stored FROM (SELECT area, made_at - to_days(CAST(length(area) % 3 * 12 AS INT)) AS made_at FROM commits) GROUP BY area) SELECT key, floor(epoch(stored))::BIGINT AS stored FROM l WHERE epoch(TIMESTAMP '2024-01-20') - epoch(stored) <= 14 * 86400")
def z14_live_pages(spark, sf_dir):
    c = view(spark, sf_dir, "commits").select(F.col("area").alias("key"), F.expr("made_at - make_dt_interval(cast(length(area) % 3 * 12 as int))").alias("stored"), F.col("author").alias("body"))
    return reports.live_pages(c, F.lit("2024-01-20")).select("key", F.floor(F.col("stored").cast("timestamp").cast("double")).cast("bigint").alias("stored"))


@register("z20_card_paths", "WITH s AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN upper(concat(scope, '/', source)) ELSE concat(scope, '/', source) END AS path FROM docs), n AS (SELECT lower(path) AS k, count(*) AS n FROM s GROUP BY 1) SELECT path, CASE WHEN n > 1 THEN concat('source-', substr(sha256(path), 1, 16), '.md') ELSE concat(path, '.md') END AS card FROM s JOIN n ON k = lower(path)")
def z20_card_paths(spark, sf_dir):
    two = F.concat_ws("/", "scope", "source")
    return reports.card_paths(docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, F.upper(two)).otherwise(two).alias("path")))


@register("z6_retry_missing", "SELECT path AS id, CASE WHEN doc_id % 3 <> 0 THEN 'first' ELSE 'second' END AS pass FROM docs WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def z6_retry_missing(spark, sf_dir):
    d = docs(spark, sf_dir)
    first = d.where("doc_id % 3 <> 0").select(F.col("path").alias("id"), F.lit("first").alias("pass"))
    second = d.where("doc_id % 2 = 0").select(F.col("path").alias("id"), F.lit("second").alias("pass"))
    return reports.missing_after(first, second, d.select(F.col("path").alias("id")))


@register("z4_inline_source", "SELECT s.id AS pointer, md5(CASE WHEN doc_id % 5 = 0 THEN concat('crux of ', s.id) WHEN span_start > len(string_split(body, chr(10))) THEN '' ELSE array_to_string(string_split(body, chr(10))[span_start:span_end], chr(10)) END) AS digest FROM spans s JOIN docs d USING (path)")
def z4_inline_source(spark, sf_dir):
    d = docs(spark, sf_dir)
    s = view(spark, sf_dir, "spans").withColumnRenamed("id", "pointer")
    cruxes = s.join(d.where("doc_id % 5 = 0").select("path"), "path", "left_semi").select("pointer", F.concat(F.lit("crux of "), "pointer").alias("crux"))
    return reports.inline_sources(s, cruxes, d).select("pointer", F.md5(F.col("code").cast("binary")).alias("digest"))


@register("g24_hunk_evidence", "WITH o AS (SELECT DISTINCT s.id, c.range_start, c.range_end, s.span_start FROM changes c JOIN spans s ON s.path = c.path AND span_start <= range_end AND span_end >= range_start) SELECT id, count(*) AS hunks, min(greatest(range_start, span_start))::BIGINT AS first_line FROM o GROUP BY id")
def g24_hunk_evidence(spark, sf_dir):
    return reports.hunk_evidence(view(spark, sf_dir, "changes"), view(spark, sf_dir, "spans")).withColumn("first_line", F.col("first_line").cast("bigint"))


@register("g25_blast_graph", f"WITH {BLAST}, v AS (SELECT id FROM seed UNION SELECT id FROM impacted) SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)")
def g25_blast_graph(spark, sf_dir):
    _, e, _, seeds, hit = blasted(spark, sf_dir)
    return reports.viz_graph(seeds, hit, e)[1].select("source", "target", "relation")


SCOPED = f"""placed AS (SELECT id, split_part(path, '/', 1) AS scope FROM nodes),
    ends AS (SELECT source, target FROM edges JOIN placed a ON a.id = source JOIN placed b ON b.id = target WHERE relation IN {WALK} AND a.scope = b.scope),
    both_ways AS (SELECT source, target FROM ends UNION ALL SELECT target, source FROM ends),
    step AS MATERIALIZED (SELECT source, target, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS p FROM both_ways GROUP BY source, target),
    lex AS (SELECT id, scope, weight AS lexical FROM ({SEEDS}) JOIN placed USING (id)),
    start AS MATERIALIZED (SELECT id, scope, lexical / sum(lexical) OVER (PARTITION BY scope) AS r FROM lex),
    move AS MATERIALIZED (SELECT source, target, 0.75 * p AS p FROM step UNION ALL SELECT s.source, start.id, 0.25 * r FROM (SELECT DISTINCT source FROM step) s JOIN placed ON placed.id = s.source JOIN start USING (scope)
      UNION ALL SELECT s.id, start.id, start.r FROM start s JOIN start USING (scope) WHERE s.id NOT IN (SELECT source FROM step)),
    walk AS (SELECT 0 AS i, id, r AS mass FROM start UNION ALL SELECT i + 1, target, sum(mass * p) FROM walk JOIN move ON source = id WHERE i < 25 GROUP BY i, target),
    ranks AS (SELECT id, scope, mass / max(mass) OVER (PARTITION BY scope) AS rank FROM walk JOIN placed USING (id) WHERE i = 25),
    both_scores AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.scope, r.scope) AS scope, coalesce(lexical / (SELECT max(lexical) FROM lex), 0) + 0.5 * coalesce(rank, 0) AS score FROM lex l FULL JOIN ranks r ON r.id = l.id WHERE lexical IS NOT NULL OR rank >= 0.15),
    best AS (SELECT scope, max(score) AS best FROM both_scores GROUP BY scope),
    kept AS (SELECT id, scope, score FROM both_scores JOIN best USING (scope) WHERE best >= 0.25 * (SELECT max(best) FROM best))"""


@register("g17_ranked_scopes", f"WITH {SCOPED} SELECT id, scope, round(score / CASE WHEN (SELECT count(*) FROM best) = 1 THEN 1 ELSE (SELECT max(score) FROM kept) END, 6) AS score FROM kept")
def g17_ranked_scopes(spark, sf_dir):
    """Scoped ranks come from a loop for all scopes at once."""
    n, e = nodes_edges(spark, sf_dir)
    n = n.withColumn("scope", F.substring_index("path", "/", 1))
    lexical = n.where("name IN ('part3', 'part5', 'customer1', 'customer8', 'supplier2')").select("id", F.length("name").cast("double").alias("lexical"))
    return reports.rank_scopes(n, e, lexical).withColumn("score", F.round("score", 6))


@register("z25_latest_rate", "WITH s AS (SELECT conv_id AS session, sum(length(text) * 3) AS micros, sum(length(text)) AS tokens, max(turn) AS mtime FROM conversations GROUP BY conv_id) SELECT first(session ORDER BY mtime DESC, session DESC) AS session, round(first(micros / tokens ORDER BY mtime DESC, session DESC), 6)::DOUBLE AS rate FROM s")
def z25_latest_rate(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    s = c.groupBy(F.col("conv_id").alias("session")).agg(F.sum(F.length("text") * 3).alias("micros"), F.sum(F.length("text")).alias("tokens"), F.max("turn").alias("mtime"))
    return reports.latest_rate(s)


@register("a26_stats", "SELECT count(*) AS nodes, sum((kind = 'file')::INT)::BIGINT AS files, count(DISTINCT language) AS languages FROM nodes")
def a26_stats(spark, sf_dir):
    return view(spark, sf_dir, "nodes").agg(F.count("*").alias("nodes"), F.sum((F.col("kind") == "file").cast("bigint")).alias("files"), F.count_distinct("language").alias("languages"))


@register("k6_file_order", "SELECT path, score FROM (SELECT path, score FROM scored ORDER BY score DESC, path LIMIT 50)")
def k6_file_order(spark, sf_dir):
    return view(spark, sf_dir, "scored").select("path", "score").orderBy(F.col("score").desc(), "path").limit(50)


