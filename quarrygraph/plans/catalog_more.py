"""Further queries: scalar functions, scopes, federation, sessions, concepts and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T
from quarrygraph.operators import concepts, drift, intervals, retrieval, scopes, sessions
from quarrygraph.plans.catalog import docs, hashed, register, scalars, tokens
from quarrygraph.plans.views import view

# scalar functions

scalars("f1_tokenize", "docs", {
    "n": (lambda: F.size(T.tokenize(F.col("body"))).cast("bigint"), f"len({tokens('body')})"),
    "digest": (lambda: F.md5(F.array_join(T.tokenize(F.col("body")), " ").cast("binary")), f"md5(array_to_string({tokens('body')}, ' '))"),
})
scalars("f2_plural_terms", "docs", {
    "thes": (lambda: T.has_term(T.tokenize(F.col("body")), F.lit("thes")), f"list_has_any({tokens('body')}, ['thes', 'thess', 'the'])"),
    "ation": (lambda: T.has_term(T.tokenize(F.col("body")), F.lit("ation")), f"list_has_any({tokens('body')}, ['ation', 'ations'])"),
})
scalars("f7_clamp", "scored", {"clamped": (lambda: T.clamp01(F.col("score") / 10 - 0.2), "CASE WHEN score / 10 - 0.2 <= 0 THEN 0 ELSE least(1, score / 10 - 0.2) END")}, "id")
scalars("f8_decay", "commits", {"weight": (lambda: F.round(T.decay(F.hour("made_at").cast("double"), 24.0), 6), "round(pow(0.5, hour(made_at) / 24.0), 6)")}, "hash")
scalars("f9_digests", "docs", {"full": (lambda: F.sha2("body", 256), "sha256(body)"), "short": (lambda: F.substring(F.sha2("path", 256), 1, 16), "substr(sha256(path), 1, 16)")})
scalars("f10_normalize_name", "docs", {"name": (lambda: T.normalize_name(F.col("body")), "lower(regexp_replace(trim(body), '\\s+', ' ', 'g'))")})
scalars("f11_slugify", "docs", {"slug": (lambda: T.slugify(F.col("body")), "coalesce(nullif(regexp_replace(regexp_replace(lower(body), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'node')")})
scalars("f12_paths", "docs", {"posix": (lambda: T.posix_path(F.concat(F.lit("\\"), F.col("path"), F.lit("//x/"))), "concat('/', path, '/x')")})
scalars("f13_path_parts", "docs", {
    "top": (lambda: T.dir_key(F.col("path"), 1), "split_part(path, '/', 1)"),
    "two": (lambda: T.dir_key(F.col("path"), 2), "concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))"),
    "dir": (lambda: T.dirname(F.col("path")), "regexp_replace(path, '/[^/]*$', '')"),
    "base": (lambda: T.basename(F.col("path")), "regexp_extract(path, '([^/]*)$', 1)"),
})
BARE = r"regexp_replace(regexp_replace(concat('Concept: ', replace(body, chr(10), ' ')), '^concepts?:\s*', '', 'i'), '^\s+|\s+$', '', 'g')"
CLAUSE = f"regexp_extract({BARE}, '(?is)^(.*?)(?:{T.CLAUSE_BREAK})', 1)"
BLANK = f"CASE WHEN contains(substr({BARE}, 1, 31), ' ') THEN length(substr({BARE}, 1, 31)) - instr(reverse(substr({BARE}, 1, 31)), ' ') ELSE -1 END"
scalars("f14_short_label", "docs", {"label": (lambda: T.short_label(F.concat(F.lit("Concept: "), F.replace("body", F.lit("\n"), F.lit(" ")))), f"CASE WHEN length({BARE}) <= 30 THEN {BARE} WHEN length({CLAUSE}) BETWEEN 8 AND 30 THEN rtrim({CLAUSE}) ELSE concat(rtrim(substr({BARE}, 1, CASE WHEN {BLANK} > 15 THEN {BLANK} ELSE 30 END)), '…') END")})
def _human(name: str) -> str:
    bare = f"regexp_replace({name}, '^(test|it|should|describe)[_\\s]*', '', 'i')"
    spaced = f"CASE WHEN regexp_matches({bare}, '^[A-Za-z]+$') AND regexp_matches({bare}, '[a-z][A-Z]') THEN regexp_replace({bare}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') ELSE {bare} END"
    words = f"trim(regexp_replace({spaced}, '[_\\-\\s]+', ' ', 'g'))"
    return f"CASE WHEN len(string_split({words}, ' ')) >= 3 THEN lower({words}) END"


scalars("f16_humanize", "docs", {
    "words": (lambda: T.humanize_test_name(F.concat(F.lit("test_"), F.regexp_replace("body", "[^A-Za-z]+", "_"))), _human("concat('test_', regexp_replace(body, '[^A-Za-z]+', '_', 'g'))")),
    "camel": (lambda: T.humanize_test_name(F.concat(F.lit("Describe"), F.initcap("scope"), F.lit("LoadsThe"), F.when(F.col("doc_id") % 2 == 0, F.lit("Table")).otherwise(F.lit("Table2")))), _human("concat('Describe', upper(substr(scope, 1, 1)), substr(scope, 2), 'LoadsThe', CASE WHEN doc_id % 2 = 0 THEN 'Table' ELSE 'Table2' END)")),
    "dashed": (lambda: T.humanize_test_name(F.concat(F.lit("should-"), F.replace("path", F.lit("/"), F.lit("-")))), _human("concat('should-', replace(path, '/', '-'))")),
})
scalars("f17_first_prose", "docs", {"prose": (lambda: T.first_prose(F.col("body")), r"coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|<!--|-)'))[1], '')")})
scalars("f18_buckets", "docs", {
    "files": (lambda: T.files_bucket(F.col("doc_id")), "CASE WHEN doc_id <= 0 THEN '0' WHEN doc_id < 50 THEN '1-49' WHEN doc_id < 200 THEN '50-199' WHEN doc_id < 1000 THEN '200-999' WHEN doc_id < 5000 THEN '1000-4999' ELSE '5000+' END"),
    "count": (lambda: T.count_bucket(F.col("doc_id") % 300), "CASE WHEN doc_id % 300 <= 0 THEN '0' WHEN doc_id % 300 < 5 THEN '1-4' WHEN doc_id % 300 < 20 THEN '5-19' WHEN doc_id % 300 < 50 THEN '20-49' WHEN doc_id % 300 < 200 THEN '50-199' ELSE '200+' END"),
    "duration": (lambda: T.duration_bucket(F.length(F.col("body")) * 100), "CASE WHEN length(body) < 10 THEN '<1s' WHEN length(body) < 50 THEN '1-5s' WHEN length(body) < 300 THEN '5-30s' WHEN length(body) < 1200 THEN '30s-2m' WHEN length(body) < 6000 THEN '2-10m' ELSE '10m+' END"),
    "saved": (lambda: T.saved_tokens_bucket(F.length(F.col("body"))), "CASE WHEN length(body) <= 0 THEN '0' WHEN length(body) < 1000 THEN '<1k' WHEN length(body) < 5000 THEN '1-5k' WHEN length(body) < 20000 THEN '5-20k' WHEN length(body) < 100000 THEN '20-100k' ELSE '100k+' END"),
})
scalars("f19_langs", "docs", {"langs": (lambda: T.langs_value(F.array(F.col("scope"), F.lit(" Go "), F.upper("scope"), F.lit("c++"), F.lit("bad lang"), F.col("source"))), "array_to_string(list_sort(list_distinct(list_filter([scope, 'go', lower(scope), 'c++', 'bad lang', lower(source)], lambda x: regexp_matches(x, '^[a-z0-9+#._-]{1,24}$'))))[1:8], ',')")})
scalars("f22_numbers", "docs", {"n": (lambda: T.number_with_suffix(F.concat(F.lit("saved "), (F.col("doc_id") % 97).cast("string"), F.lit(".5k tokens"))), "(doc_id % 97 + 0.5)::DOUBLE * 1000")})
scalars("f23_tokens", "docs", {"tokens": (lambda: T.to_tokens(F.length(F.col("body"))), "floor(length(body) / 4.0 + 0.5)::BIGINT")})
scalars("f25_handles", "docs", {"handle": (lambda: T.github_handle(F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("+"))).otherwise(F.lit("")), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("@x.org")).otherwise(F.lit("@users.noreply.github.com")))), "CASE WHEN doc_id % 3 <> 0 THEN source END")})
scalars("f26_search_body", "docs", {"n": (lambda: F.length(T.search_body(F.col("body"))), "length(substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 5000))"), "digest": (lambda: F.md5(T.search_body(F.col("body"), 200).cast("binary")), "md5(substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 200))")})
def _span_sql(start: int, end: int, cap: int) -> str:
    lines, first = "string_split(body, chr(10))", max(1, start)
    last = f"least({end}, len({lines}))"
    n = f"greatest({last} - {first} + 1, 0)"
    kept = f"array_to_string({lines}[{first}:least({first + cap - 1}, {last})], chr(10))"
    return f"md5(CASE WHEN {n} = 0 THEN '' WHEN {n} > {cap} THEN concat({kept}, chr(10), '… (+', {n} - {cap}, ' more lines; open ', path, ':L{first}-L', {last}, ')') ELSE {kept} END)"


scalars("f28_slice_span", "docs", {name: (lambda a=a, b=b, cap=cap: F.md5(T.slice_span(F.col("body"), F.lit(a), F.lit(b), cap, F.col("path")).cast("binary")), _span_sql(a, b, cap)) for name, a, b, cap in (("digest", 2, 4, 80), ("clamped", -3, 100, 80), ("capped", 1, 1000, 3))})
scalars("f29_reference_line", "docs", {"line": (lambda: T.reference_line(F.col("body"), "the", F.lit(1), F.lit(9)), "trim(list_filter(string_split(body, chr(10))[1:9], lambda x: regexp_matches(x, '\\bthe\\b'))[1])")})
scalars("f31_ordinals", "nodes", {"plain": (lambda: T.strip_ordinals(F.concat(F.col("id"), F.lit("~2.run~3"))), "concat(id, '.run')"), "owner": (lambda: T.owner_of_method(F.concat_ws(".", "id", F.lit("run"))), "nullif(regexp_extract(id, '#([^.]*)', 1), '')")}, "id")
scalars("f34_subject_words", "docs", {"words": (lambda: F.array_join(T.subject_words(F.concat("body", F.lit(" who calls evict() in src/a.ts#Cache.get"))), " "), "array_to_string(list_transform(list_sort(list_transform(list_distinct(flatten(list_transform(regexp_extract_all(concat(body, ' who calls evict() in src/a.ts#Cache.get'), '" + T.SUBJECT_WORD + "'), lambda w: CASE WHEN ends_with(w, '()') THEN [w, substr(w, 1, length(w) - 2)] ELSE [w] END))), lambda w: {'n': -length(w), 'w': w})), lambda s: s.w), ' ')")})
scalars("p6_test_paths", "nodes", {"test": (lambda: T.is_test_path(F.col("path")), "path LIKE '%/tests/%'"), "factor": (lambda: T.test_factor(F.col("path")), "CASE WHEN path LIKE '%/tests/%' THEN 0.35 ELSE 1.0 END::DOUBLE")}, "id")
scalars("p1_path_under", "docs", {"under": (lambda: T.path_under(F.col("path"), F.lit("en/src1")), "path = 'en/src1' OR starts_with(path, 'en/src1/')")})


scalars("p12_span_bounds", "spans", {"lo": (lambda: T.span_bounds(F.concat(F.lit("L"), F.col("span_start").cast("string"), F.lit("-L"), F.col("span_end").cast("string")))[0], "span_start::INT"), "hi": (lambda: T.span_bounds(F.concat(F.lit("x"), F.col("span_start").cast("string")))[1], "CAST(NULL AS INT)")}, "id")


@register("f36_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f36_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.try_to_number(F.get_json_object("props", "$.k"), F.lit("9999999999")).cast("bigint").alias("k"))


VERB = "['influences', 'supports', 'defines', 'measures', 'part_of', 'depends_on', 'other', relation][length(source) % 8 + 1]"


@register("f30_relation_family", f"""SELECT verb, normal, CASE WHEN normal IN ('part_of', 'contains') THEN 'structure' WHEN normal IN ('extends', 'implements') THEN 'contract'
  WHEN normal IN ('uses', 'depends_on', 'calls', 'imports', 'produces', 'configures', 'validates') THEN 'dependency' ELSE 'association' END AS family, count(*) AS n
  FROM (SELECT verb, CASE WHEN verb = 'influences' THEN 'configures' WHEN verb IN ('supports', 'defines', 'measures') THEN 'validates' ELSE verb END AS normal
    FROM (SELECT {VERB} AS verb FROM edges UNION ALL SELECT relation FROM edges)) GROUP BY ALL""")
def f30_relation_family(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    some = F.array(*map(F.lit, ("influences", "supports", "defines", "measures", "part_of", "depends_on", "other")), F.col("relation"))
    verbs = e.select(F.get(some, F.length("source") % 8).alias("verb")).unionByName(e.select(F.col("relation").alias("verb")))
    normal = T.normalize_relation(F.col("verb"))
    return verbs.groupBy("verb", normal.alias("normal"), T.relation_family(normal).alias("family")).agg(F.count("*").alias("n"))


@register("p8_literal_ignore_case", "SELECT path, count(*) AS n FROM (SELECT path, unnest(string_split(body, chr(10))) AS l FROM docs) WHERE contains(lower(l), 'license.') GROUP BY path")
def p8_literal_ignore_case(spark, sf_dir):
    return intervals.matching_lines(docs(spark, sf_dir), "LICENSE.", literal=True, ignore_case=True).groupBy("path").agg(F.count("*").alias("n"))


@register("p16_skeleton", "SELECT id, span_start, span_end FROM spans WHERE path = (SELECT min(path) FROM docs WHERE path LIKE '%doc7') ORDER BY span_start")
def p16_skeleton(spark, sf_dir):
    s = view(spark, sf_dir, "spans").where(F.col("path").endswith("doc7"))
    one = s.agg(F.min("path").alias("path"))
    return s.join(F.broadcast(one), "path").select("id", "span_start", "span_end").orderBy("span_start")


@register("p15_exported", "SELECT name, kind, path FROM nodes WHERE kind <> 'file' ORDER BY id LIMIT 4000")
def p15_exported(spark, sf_dir):
    return view(spark, sf_dir, "nodes").where("kind <> 'file'").orderBy("id").limit(4000).select("name", "kind", "path")


# scopes and federation

SCOPES = "sc AS (SELECT 'en' AS prefix UNION ALL SELECT 'en/src1' UNION ALL SELECT 'de/src3' UNION ALL SELECT 'fr')"


def some_scopes(spark):
    return spark.createDataFrame([("en",), ("en/src1",), ("de/src3",), ("fr",)], "prefix string")


@register("j22_assign_scope", f"WITH {SCOPES} SELECT path, coalesce(first(prefix ORDER BY length(prefix) DESC) FILTER (prefix IS NOT NULL), '') AS prefix FROM docs LEFT JOIN sc ON path = prefix OR starts_with(path, concat(prefix, '/')) GROUP BY path")
def j22_assign_scope(spark, sf_dir):
    return scopes.assign_scope(docs(spark, sf_dir), some_scopes(spark))


@register("a32_fold_small_scopes", f"WITH {SCOPES}, a AS (SELECT path, coalesce(first(prefix ORDER BY length(prefix) DESC) FILTER (prefix IS NOT NULL), '') AS prefix FROM docs LEFT JOIN sc ON path = prefix OR starts_with(path, concat(prefix, '/')) GROUP BY path), n AS (SELECT prefix, count(*) AS n FROM a GROUP BY prefix) SELECT CASE WHEN n >= 30 THEN prefix ELSE '' END AS prefix, sum(n)::BIGINT AS symbols FROM n GROUP BY 1")
def a32_fold_small_scopes(spark, sf_dir):
    return scopes.fold_small(scopes.assign_scope(docs(spark, sf_dir), some_scopes(spark)), 30)


@register("g30_discover_scopes", """WITH m AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, 'pkg' AS marker FROM docs WHERE scope <> 'de' UNION SELECT DISTINCT concat(scope, '/', source), 'pkg' FROM docs UNION SELECT DISTINCT concat(scope, '/', source), 'mod' FROM docs WHERE doc_id % 9 = 0)
    SELECT dir AS prefix, CASE WHEN dir = '' THEN 'root' ELSE regexp_extract(dir, '([^/]*)$', 1) END AS label, string_agg(marker, ',' ORDER BY marker) AS markers FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.marker = m.marker AND starts_with(m.dir, concat(o.dir, '/'))) GROUP BY dir""")
def g30_discover_scopes(spark, sf_dir):
    d = docs(spark, sf_dir)
    two = F.concat_ws("/", "scope", "source")
    m = d.where("scope <> 'de'").select(F.col("scope").alias("dir"), F.lit("pkg").alias("marker")).union(d.select(two, F.lit("pkg"))).union(d.where("doc_id % 9 = 0").select(two, F.lit("mod"))).distinct()
    return scopes.discover(m).withColumn("markers", F.array_join("markers", ","))


@register("u5_federated_rows", "SELECT concat(CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END, '/', path) AS path, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS child FROM docs")
def u5_federated_rows(spark, sf_dir):
    d = docs(spark, sf_dir)
    return scopes.federate_rows({"even": d.where("doc_id % 2 = 0"), "odd": d.where("doc_id % 2 = 1")}).select("path", "child")


@register("g26_federated_ranking", """WITH s AS (SELECT path AS id, source AS child, path AS grp, concat(source, '/', scope) AS file, round(length(body) % 997 / 997.0, 6)::DOUBLE + doc_id % 3 AS score, (doc_id % 40 = 0)::INT::DOUBLE AS strong FROM docs),
    gate AS (SELECT child FROM s GROUP BY child HAVING max(strong) >= 0.1), o AS (SELECT * FROM s WHERE child IN (SELECT child FROM gate)),
    lead AS (SELECT child, file, max(score) AS score FROM o GROUP BY ALL), best AS (SELECT child, max(score) AS best FROM lead GROUP BY child), part AS (SELECT child, best FROM best WHERE best >= 0.25 * (SELECT max(best) FROM best)),
    pl AS (SELECT child, file, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY child ORDER BY score DESC, concat(child, '/', file))) AS rrf FROM lead JOIN part USING (child)),
    f AS (SELECT child, file, rrf / max(rrf) OVER () AS fused FROM pl),
    r AS (SELECT o.id, o.child, o.score, concat(o.child, '/', o.file) AS grp, round(fused, 9) AS fused, o.id = (SELECT first(id ORDER BY score DESC, id DESC) FROM o) AS locked FROM o JOIN f USING (child, file)),
    p AS (SELECT *, row_number() OVER (ORDER BY locked DESC, fused DESC, grp, score DESC, id) AS place FROM r),
    d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place) AS depth, min(place) OVER (PARTITION BY grp) AS lead FROM p)
    SELECT id, child, round(score, 6) AS score, row_number() OVER (ORDER BY depth, lead) AS position FROM d ORDER BY depth, lead LIMIT 20""")
def g26_federated_ranking(spark, sf_dir):
    d = docs(spark, sf_dir)
    s = d.select(F.col("path").alias("id"), F.col("source").alias("child"), F.concat_ws("/", "source", "scope").alias("file"), (F.round(F.length("body") % 997 / 997.0, 6) + F.col("doc_id") % 3).alias("score"), (F.col("doc_id") % 40 == 0).cast("int").cast("double").alias("strong"), F.lit(0.0).alias("broad"))
    return scopes.federated_ranking(s, 20).withColumn("score", F.round("score", 6))


@register("g27_federated_degree", "SELECT split_part(source, '/', 1) AS child, target AS id, count(*) AS degree FROM edges WHERE relation <> 'contains' GROUP BY ALL")
def g27_federated_degree(spark, sf_dir):
    e = view(spark, sf_dir, "edges").where("relation <> 'contains'")
    return e.groupBy(F.substring_index("source", "/", 1).alias("child"), F.col("target").alias("id")).agg(F.count("*").alias("degree"))


@register("j24_children", "WITH c AS (SELECT DISTINCT source AS child FROM docs UNION SELECT 'gone') SELECT child, CASE WHEN child IN (SELECT source FROM docs WHERE scope = 'fr') THEN 'loaded' ELSE 'missing' END AS state FROM c")
def j24_children(spark, sf_dir):
    d = docs(spark, sf_dir)
    children = d.select(F.col("source").alias("child")).union(spark.createDataFrame([("gone",)], "child string")).distinct()
    return scopes.children_loaded(children, d.where("scope = 'fr'").select(F.col("source").alias("child")))


@register("j23_unique_suffix", "WITH p AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM nodes) SELECT name, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM p GROUP BY name")
def j23_unique_suffix(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    return scopes.unique_suffix(n.select(T.basename(F.col("path")).alias("name")), n)


# sessions, queues and reports

def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


SESSIONS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
    s AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM n GROUP BY user_id, session)"""


@register("x1_sessions", f"WITH {SESSIONS} SELECT user_id, floor(epoch(start))::BIGINT AS start, floor(epoch(last))::BIGINT AS finish, events FROM s")
def x1_sessions(spark, sf_dir):
    s = sessions.sessions(events(spark, sf_dir))
    return s.select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), F.unix_seconds(F.col("end").cast("timestamp")).alias("finish"), "events")


@register("a21_session_report", f"WITH {SESSIONS}, d AS (SELECT events, epoch(last) - epoch(start) AS sec FROM s) SELECT CASE WHEN events < 5 THEN '1-4' WHEN events < 20 THEN '5-19' WHEN events < 50 THEN '20-49' WHEN events < 200 THEN '50-199' ELSE '200+' END AS events_bucket, CASE WHEN sec < 1 THEN '<1s' WHEN sec < 5 THEN '1-5s' WHEN sec < 30 THEN '5-30s' WHEN sec < 120 THEN '30s-2m' WHEN sec < 600 THEN '2-10m' ELSE '10m+' END AS duration_bucket, count(*) AS sessions FROM d GROUP BY ALL")
def a21_session_report(spark, sf_dir):
    s = sessions.sessions(events(spark, sf_dir))
    return sessions.session_report(s.withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp")))


@register("x4_session_counters", "SELECT user_id, count(*) AS events, sum((event_type = 'click')::INT)::BIGINT AS n_click, sum((event_type = 'view')::INT)::BIGINT AS n_view, sum((event_type = 'purchase')::INT)::BIGINT AS n_purchase, first(event_id ORDER BY ts DESC, event_id DESC) AS latest FROM events GROUP BY user_id")
def x4_session_counters(spark, sf_dir):
    return sessions.session_counters(events(spark, sf_dir))


@register("x2_last_write_wins", "SELECT user_id, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(event_type ORDER BY ts DESC, event_id DESC) AS event_type, min(event_id) AS place FROM events GROUP BY user_id")
def x2_last_write_wins(spark, sf_dir):
    e = events(spark, sf_dir)
    return sessions.last_write_wins(e, "user_id", F.struct("ts", "event_id"), F.col("event_id")).select("user_id", "event_id", "event_type", "place")


@register("x5_dedupe_turns", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def x5_dedupe_turns(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@register("x6_novelty", "WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM n) SELECT event_id FROM b WHERE before IS NULL OR n - before > 3")
def x6_novelty(spark, sf_dir):
    return sessions.novel(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id", 3).select("event_id")


@register("x9_queue_tail", "WITH t AS (SELECT event_id, sum(length(props) * 40) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY event_id DESC) AS n FROM events) SELECT event_id FROM t WHERE n <= 500 AND used <= 100000")
def x9_queue_tail(spark, sf_dir):
    return sessions.queue_tail(events(spark, sf_dir), "event_id", F.length("props") * 40, 500, 100000).select("event_id")


@register("x3_admission", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'event' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'action' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'draft' END AS skip FROM events")
def x3_admission(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "pull_request").when(F.col("event_type") == "view", "push").otherwise("star")
    e = events(spark, sf_dir).select("event_id", kind.alias("event"), F.when(F.col("event_id") % 3 == 0, "closed").otherwise("opened").alias("action"), (F.col("event_id") % 5 == 0).alias("draft"))
    return sessions.admitted(e).select("event_id", "skip")


@register("a23_turn_cost", "WITH m AS (SELECT DISTINCT conv_id, turn // 2 AS m FROM conversations), c AS (SELECT conv_id, m, 1000 + m * 10 AS i, 200 AS w, 5000 AS r FROM m) SELECT conv_id AS session, sum(round((i + 1.25 * w + 0.1 * r) * 3.0)::BIGINT)::BIGINT AS micros, sum(i + w + r)::BIGINT AS tokens FROM c GROUP BY conv_id")
def a23_turn_cost(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m = c.select(F.col("conv_id").alias("session"), F.floor(F.col("turn") / 2).alias("message_id"))
    m = m.select("session", "message_id", (1000 + F.col("message_id") * 10).alias("input_tokens"), F.lit(200).alias("cache_write"), F.lit(5000).alias("cache_read"), F.lit(3.0).alias("price"))
    return sessions.turn_cost(m)


@register("a24_audit", "WITH t AS (SELECT length(text) AS saved, CASE WHEN turn % 2 = 0 THEN length(text) + turn * 15 END AS reported FROM conversations) SELECT count(*) AS turns, round(100.0 * count(reported) / count(*), 4)::DOUBLE AS reported_percent, median(saved)::DOUBLE AS median_saved, round(100.0 * sum((abs(reported - saved) <= 0.1 * saved)::INT) / count(reported), 4)::DOUBLE AS within_percent, sum((reported >= 1000000)::INT)::BIGINT AS outliers FROM t")
def a24_audit(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return sessions.audit(c.select(F.length("text").alias("saved"), F.when(F.col("turn") % 2 == 0, F.length("text") + F.col("turn") * 15).alias("reported")))


@register("a25_nearest_rank", "WITH v AS (SELECT length(body) AS n, row_number() OVER (ORDER BY length(body)) AS r, count(*) OVER () AS c FROM docs) SELECT max(CASE WHEN r = ceil(c * 0.95) THEN n END) AS p95 FROM v")
def a25_nearest_rank(spark, sf_dir):
    return sessions.nearest_rank(docs(spark, sf_dir).select(F.length("body").alias("n")), "n", 0.95).withColumnRenamed("value", "p95")


@register("a20_sum_captured", "SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(body, '[0-9]{1,6}'), lambda x: x::BIGINT)), 0)::BIGINT AS total FROM docs")
def a20_sum_captured(spark, sf_dir):
    found = F.regexp_extract_all(F.col("body"), F.lit("[0-9]{1,6}"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", F.aggregate(found, F.lit(0).cast("bigint"), lambda t, x: t + x.cast("bigint")).alias("total"))


# folds in order

@register("a28_batches", """WITH o AS (SELECT scope, doc_id, length(body) AS n, row_number() OVER (PARTITION BY scope ORDER BY doc_id) AS k FROM docs),
    f AS (SELECT scope, k, doc_id, n AS used, 0 AS batch FROM o WHERE k = 1 UNION ALL SELECT o.scope, o.k, o.doc_id, CASE WHEN used + o.n > 48000 THEN o.n ELSE used + o.n END, CASE WHEN used > 0 AND used + o.n > 48000 THEN batch + 1 ELSE batch END FROM f JOIN o ON o.scope = f.scope AND o.k = f.k + 1)
    SELECT scope, doc_id, batch::BIGINT AS batch FROM f""")
def a28_batches(spark, sf_dir):
    d = docs(spark, sf_dir).select("scope", "doc_id", F.length("body").alias("n"))
    return sessions.pack_batches(d, "scope", "doc_id", "n").select(F.col("group").alias("scope"), F.col("seq").alias("doc_id"), "batch")


@register("a29_budgeted", """WITH o AS (SELECT doc_id, length(body) AS n, row_number() OVER (ORDER BY doc_id % 4, doc_id) AS k FROM docs),
    f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS used, 0 AS taken, false AS took UNION ALL SELECT o.k, o.doc_id, CASE WHEN taken < 40 AND used + o.n <= 60000 THEN used + o.n ELSE used END, CASE WHEN taken < 40 AND used + o.n <= 60000 THEN taken + 1 ELSE taken END, taken < 40 AND used + o.n <= 60000 FROM f JOIN o ON o.k = f.k + 1)
    SELECT doc_id FROM f WHERE took""")
def a29_budgeted(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.length("body").alias("n"))
    return sessions.budgeted(d, [F.col("doc_id") % 4, F.col("doc_id")], F.col("n"), 60000, 40).select("doc_id")


@register("x11_circuit_breaker", """WITH a AS (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN 'ok' WHEN event_id % 101 = 0 THEN 'terminal' WHEN event_id % 5 = 0 THEN 'quality' ELSE 'failed' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, 0::BIGINT AS tried, 0 AS run, false AS stopped FROM (SELECT DISTINCT user_id FROM a) UNION ALL SELECT f.user_id, tried + 1, CASE WHEN outcome = 'ok' THEN 0 WHEN outcome = 'failed' THEN run + 1 ELSE run END, outcome = 'terminal' OR (CASE WHEN outcome = 'ok' THEN 0 WHEN outcome = 'failed' THEN run + 1 ELSE run END) >= 3 FROM f JOIN a ON a.user_id = f.user_id AND a.k = tried + 1 WHERE NOT stopped)
    SELECT user_id, max(tried) AS tried, bool_or(stopped) AS stopped FROM f GROUP BY user_id""")
def x11_circuit_breaker(spark, sf_dir):
    outcome = F.when(F.col("event_id") % 7 == 0, "ok").when(F.col("event_id") % 101 == 0, "terminal").when(F.col("event_id") % 5 == 0, "quality").otherwise("failed")
    return sessions.circuit_breaker(events(spark, sf_dir).select("user_id", "event_id", outcome.alias("outcome")), "user_id", "event_id", 3)


# concepts

def concept_parts(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("source").alias("name"), F.col("body").alias("summary"), F.array("path").alias("sources"))


@register("g34_merge_concepts", "SELECT source AS slug, min(source) AS name, first(body ORDER BY length(body) DESC, body DESC) AS summary, string_agg(DISTINCT path, ',' ORDER BY path) AS sources FROM docs GROUP BY source")
def g34_merge_concepts(spark, sf_dir):
    return concepts.merge_concepts(concept_parts(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@register("j17_link_concepts", "WITH l AS (SELECT DISTINCT source AS slug, concat('  SRC', doc_id % 25, ' ') AS target, scope AS relation FROM docs) SELECT DISTINCT slug, lower(trim(target)) AS \"to\", relation FROM l WHERE lower(trim(target)) IN (SELECT source FROM docs) AND lower(trim(target)) <> slug")
def j17_link_concepts(spark, sf_dir):
    d = docs(spark, sf_dir)
    links = d.select(F.col("source").alias("slug"), F.concat(F.lit("  SRC"), (F.col("doc_id") % 25).cast("string"), F.lit(" ")).alias("target"), F.col("scope").alias("relation"))
    return concepts.link_concepts(links, d.select(F.col("source").alias("slug"), F.col("source").alias("name")).distinct())


@register("j16_known_links", "SELECT DISTINCT source AS slug, concat('src', doc_id % 25) AS \"to\" FROM docs WHERE concat('src', doc_id % 25) IN (SELECT source FROM docs)")
def j16_known_links(spark, sf_dir):
    d = docs(spark, sf_dir)
    links = d.select(F.col("source").alias("slug"), F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("to")).distinct()
    return concepts.known_links(links, d.select(F.col("source").alias("slug")).distinct())[0].select("slug", "to")


@register("j18_inherit_sources", "WITH c AS (SELECT source AS slug, list_sort(list_distinct(list(path))) AS s FROM docs GROUP BY source) SELECT slug, array_to_string(CASE WHEN slug = 'src1' THEN (SELECT s FROM c WHERE slug = 'src2') WHEN slug = 'src3' THEN [] ELSE s END, ',') AS sources FROM c")
def j18_inherit_sources(spark, sf_dir):
    c = concepts.merge_concepts(concept_parts(spark, sf_dir)).select("slug", F.when(F.col("slug").isin("src1", "src3"), F.expr("cast(array() as array<string>)")).otherwise(F.col("sources")).alias("sources"))
    return concepts.inherit_sources(c, spark.createDataFrame([("src1", "src2"), ("src3", "src1")], "slug string, to string")).withColumn("sources", F.array_join("sources", ","))


@register("j15_covers", "WITH s AS (SELECT path, string_agg(name, ',' ORDER BY name) AS symbols FROM nodes WHERE kind <> 'file' GROUP BY path) SELECT n.name AS slug, n.path, coalesce(symbols, '') AS symbols FROM nodes n LEFT JOIN s USING (path) WHERE n.kind = 'file'")
def j15_covers(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    c = n.where("kind = 'file'").select(F.col("name").alias("slug"), F.array("path").alias("sources"))
    return concepts.covers(c, n).withColumn("symbols", F.array_join("symbols", ","))


@register("j13_rules", "WITH r AS (SELECT concat('rule', doc_id % 9) AS rule, path AS symbol, CASE WHEN doc_id % 2 = 0 THEN sha256(body) ELSE 'old' END AS fp, sha256(body) AS hash FROM docs WHERE scope = 'en') SELECT rule, min(symbol) AS symbol, first(fp <> hash ORDER BY symbol) AS stale FROM r GROUP BY rule ORDER BY rule LIMIT 6")
def j13_rules(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash", F.sha2("body", 256))
    r = d.select(F.concat(F.lit("rule"), (F.col("doc_id") % 9).cast("string")).alias("rule"), F.col("path").alias("symbol"), F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise(F.lit("old")).alias("fingerprint"))
    return concepts.attach_rules(r, d.select(F.col("path").alias("id"), "hash"), d.where("scope = 'en'").select(F.col("path").alias("id")))


@register("j14_commit_symbols", "WITH c AS (SELECT DISTINCT CASE WHEN kind = 'file' THEN path END AS path FROM nodes WHERE path LIKE 'sales/%'), h AS (SELECT DISTINCT split_part(n.path, '/', 2) AS hash, name FROM nodes n WHERE kind <> 'file' AND path LIKE 'sales/%'), p AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY name) AS k FROM h) SELECT hash, string_agg(name, ',' ORDER BY name) AS symbols FROM p WHERE k <= 20 GROUP BY hash")
def j14_commit_symbols(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    c = n.where("path like 'sales/%'").select(F.split_part("path", F.lit("/"), F.lit(2)).alias("hash"), "path")
    return concepts.commit_symbols(c, n).withColumn("symbols", F.array_join("symbols", ","))


@register("a11_cards", "SELECT path, concat('# ', path, chr(10), chr(10), string_agg(concat('- ', kind, ' `', name, '`'), chr(10) ORDER BY name, kind), chr(10)) AS card FROM nodes WHERE kind <> 'file' GROUP BY path")
def a11_cards(spark, sf_dir):
    return concepts.cards(view(spark, sf_dir, "nodes"), F.col("name"))


@register("z9_scope_footer", "SELECT scope, count(*) AS n FROM docs GROUP BY scope")
def z9_scope_footer(spark, sf_dir):
    return concepts.scope_footer(docs(spark, sf_dir))


@register("j10_manifest_drift", "SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'unindexed' WHEN sha256(a.text) <> sha256(b.text) THEN 'changed' WHEN b.path NOT LIKE 'en/%' THEN 'uncovered' ELSE 'fresh' END AS state FROM committed a FULL JOIN current_files b ON a.path = b.path")
def j10_manifest_drift(spark, sf_dir):
    return concepts.stale_manifest(hashed(view(spark, sf_dir, "current_files")), hashed(view(spark, sf_dir, "committed")), docs(spark, sf_dir).where("path like 'en/%'"))


@register("s14_merge_rows", "SELECT path, sha256(text) AS hash FROM current_files UNION ALL SELECT path, sha256(text) FROM committed WHERE path NOT IN (SELECT path FROM current_files)")
def s14_merge_rows(spark, sf_dir):
    rows = lambda n: hashed(view(spark, sf_dir, n)).select("path", "hash")
    return drift.merge_rows(rows("committed"), rows("current_files"), "path")


@register("u3_set_difference", "SELECT id, 'added' AS side FROM current_files WHERE id NOT IN (SELECT id FROM committed) UNION ALL SELECT id, 'removed' FROM committed WHERE id NOT IN (SELECT id FROM current_files)")
def u3_set_difference(spark, sf_dir):
    a, b = view(spark, sf_dir, "committed").select("id"), view(spark, sf_dir, "current_files").select("id")
    return b.join(a, "id", "left_anti").withColumn("side", F.lit("added")).unionByName(a.join(b, "id", "left_anti").withColumn("side", F.lit("removed")))


@register("u4_intersection", "SELECT id FROM current_files INTERSECT SELECT id FROM committed")
def u4_intersection(spark, sf_dir):
    return view(spark, sf_dir, "current_files").select("id").intersect(view(spark, sf_dir, "committed").select("id"))


@register("k11_top_lock", "SELECT id, scope, row_number() OVER (ORDER BY (id = (SELECT min(id) FROM scored)) DESC, score DESC, scope, id) AS position FROM scored")
def k11_top_lock(spark, sf_dir):
    s = view(spark, sf_dir, "scored").withColumn("place", F.struct((-F.col("score")).alias("s"), "scope", "id"))
    low = s.agg(F.min("id").alias("low"))
    rows = retrieval.top_lock(s.crossJoin(F.broadcast(low)), F.col("id") == F.col("low"), "place")  # one row
    return rows.select("id", "scope", F.row_number().over(Window.orderBy(F.col("locked").desc(), "place")).cast("bigint").alias("position"))


@register("u6_merge_ranked", "WITH a AS (SELECT id, score / max(score) OVER () AS score FROM scored WHERE scope = 'en'), b AS (SELECT id, score / max(score) OVER () AS score FROM scored WHERE scope <> 'en') SELECT id, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY round(score, 6) DESC, id LIMIT 30")
def u6_merge_ranked(spark, sf_dir):
    s = view(spark, sf_dir, "scored")

    def part(rows):
        return rows.crossJoin(F.broadcast(rows.agg(F.max("score").alias("top")))).select("id", F.round(F.col("score") / F.col("top"), 6).alias("score"))  # one row

    return part(s.where("scope = 'en'")).unionByName(part(s.where("scope <> 'en'"))).orderBy(F.col("score").desc(), "id").limit(30)


@register("k1_sorted_edges", "SELECT source, relation, target FROM edges ORDER BY source, relation, target")
def k1_sorted_edges(spark, sf_dir):
    return view(spark, sf_dir, "edges").select("source", "relation", "target").orderBy("source", "relation", "target")
