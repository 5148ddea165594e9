"""Queries of resolution rules, prices, versions, packs and other upkeep, over inputs whose answers are known by how they
are made."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import drift, graph, reports, resolve, retrieval, sessions
from quarrygraph.plans.catalog import LEXICAL, QUERY, WALK, _walk, docs, nodes_edges, register, scalars
from quarrygraph.plans.shared import shared_folder
from quarrygraph.plans.views import view
from quarrygraph.sources import files

def doc():
    return F.col("doc_id")


def turn_of(*values):
    """The value at ``doc_id`` modulo their number."""
    out = F.lit(None).cast("string")
    for n, v in enumerate(values):
        out = F.when(doc() % len(values) == n, F.lit(v)).otherwise(out)
    return out


TOOLS = (("Read", None), ("mcp__quarry__quarry_find", None), ("Bash", "cd x && npx -y quarry ask q"), ("Bash", "ls ./quarry"), ("Edit", None), ("GREP", "x"), ("MCP:other_quarry_find", None), (None, "quarry"))
scalars("f21_tool_use", "docs", {"use": (lambda: sessions.tool_use(turn_of(*[t for t, _ in TOOLS]), turn_of(*[c for _, c in TOOLS]), ["quarry_find"], "quarry"), "CASE WHEN doc_id % 8 IN (0, 5) THEN 'source' WHEN doc_id % 8 IN (1, 2) THEN 'own' END")})
RATES = [("model-a-(1|2)", 5), ("model-a", 3), ("model-b", 1)]
scalars("f24_dollars", "docs", {
    "micros": (lambda: sessions.turn_micros(sessions.price_of(turn_of("model-a-2", "model-a-9", "model-b", "other"), RATES), doc(), doc() * 4, doc() * 10), "(doc_id * 7 * CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 END)::BIGINT"),
    "dollars": (lambda: T.format_dollars(sessions.dollars_saved(doc() * 100, doc() % 5, F.lit(50))), "CASE WHEN doc_id % 5 = 0 OR doc_id = 0 THEN NULL WHEN doc_id * (doc_id % 5) * 2 < 10000 THEN '<$0.01' ELSE printf('$%.2f', doc_id * 100 * ((doc_id % 5) / 50.0::DOUBLE) / 1000000) END"),
})
scalars("f23_since", "docs", {"since": (lambda: T.since_label(doc() % 900), "CASE WHEN doc_id % 900 = 0 THEN 'today' WHEN doc_id % 900 = 1 THEN 'yesterday' WHEN doc_id % 900 < 31 THEN concat(doc_id % 900, 'd ago') WHEN doc_id % 900 < 705 THEN concat(floor((doc_id % 900 + 15) / 30.0)::INT, 'mo ago') ELSE concat(round(doc_id % 900 / 365.0)::INT, 'y ago') END")})
scalars("k13_versions", "docs", {"newer": (lambda: T.is_newer(F.concat((doc() % 3).cast("string"), F.lit("."), (doc() % 12).cast("string"), F.when(doc() % 2 == 0, ".0-beta.9").otherwise("")), F.lit("1.2.0")), "doc_id % 3 = 2 OR (doc_id % 3 = 1 AND doc_id % 12 > 2)")})
HEADS = (
    ("go", "Client.Do", "func (c *Client) Do() {", True), ("go", "run", "func run() {", False), ("java", "f", "public static int f() {", True), ("java", "f", "@Test int f() {", False),
    ("kotlin", "f", "fun f() {", True), ("kotlin", "f", "internal fun f() {", False), ("swift", "x", "private(set) var x: Int", True), ("swift", "f", "fileprivate func f() {", False),
    ("php", "f", "function f() {", True), ("php", "f", "protected static function f() {", False), ("typescript", "f", "export async function f() {", True), ("typescript", "f", "function f() {", False),
    ("r", "f", "f <- function() 1", True), ("r", ".f", ".f <- function() 1", False), ("python", "K._f", "def _f(self):", False), ("rust", "f", "pub(crate) fn f() {", True), ("lua", "f", "function f()", True),
)
scalars("p17_exported", "docs", {"exported": (lambda: T.exported(turn_of(*[h[0] for h in HEADS]), turn_of(*[h[1] for h in HEADS]), turn_of(*[h[2] for h in HEADS])), f"doc_id % {len(HEADS)} IN ({', '.join(str(n) for n, h in enumerate(HEADS) if h[3])})")})


@register("a22_session_mix", "WITH s AS (SELECT user_id, sum((event_type = 'click')::INT) AS own, sum((event_type = 'view')::INT) AS source FROM events GROUP BY user_id) SELECT user_id, CASE WHEN own + source = 0 THEN 'no retrieval yet' ELSE concat(round(100.0 * own / (own + source))::INT, '%') END AS mix FROM s")
def a22_session_mix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("own"), F.count_if(F.col("event_type") == "view").alias("source"))
    return e.select("user_id", sessions.mix_label(F.col("own"), F.col("source")).alias("mix"))


@register("a22_latest_session", "SELECT user_id AS session, count(*) AS n FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id DESC LIMIT 1")
def a22_latest_session(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("mtime"), F.count("*").alias("n"))
    return sessions.latest_session(e).select("session", "n")


@register("z8_test_headline", """WITH a AS (SELECT scope AS report, source AS label, min(doc_id) % 3 AS state FROM docs GROUP BY ALL),
    r AS (SELECT report, string_agg(CASE WHEN state = 0 THEN label END, ', ' ORDER BY label) AS bare, string_agg(CASE WHEN state = 1 THEN label END, ', ' ORDER BY label) AS stale, sum((state = 1)::INT) AS n, sum((state = 2)::INT) AS m FROM a GROUP BY report)
    SELECT report, concat('Tests: ', concat_ws('; ', '**no test reaches ' || bare || '**', stale || CASE WHEN n = 1 THEN ' has' ELSE ' have' END || ' tests the diff did not touch', CASE WHEN m = 1 THEN '1 area updated its tests' WHEN m > 1 THEN m || ' areas updated their tests' END), '.') AS headline FROM r""")
def z8_test_headline(spark, sf_dir):
    a = docs(spark, sf_dir).groupBy(F.col("scope").alias("report"), F.col("source").alias("label")).agg((F.min("doc_id") % 3).alias("n"))
    tests = F.element_at(F.array(F.lit("none"), F.lit("stale"), F.lit("changed")), (F.col("n") + 1).cast("int"))
    return reports.test_headline(a.select("report", F.col("label").alias("place"), "label", tests.alias("tests")))


@register("z11_pack_savings", r"""WITH h AS (SELECT path, source AS query, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, length(body) AS chars, trim(regexp_replace(body, '\s+', ' ', 'g')) AS flat, CASE WHEN doc_id % 2 = 0 THEN 'x = 1' END AS code FROM docs),
    b AS (SELECT query, sum(chars) AS chars FROM h GROUP BY query),
    p AS (SELECT query, 4 + sum(1 + 1 + length(place::VARCHAR) + 2 + 1 + 2 + length(path) + CASE WHEN flat <> '' THEN 5 + length(substr(flat, 1, 140)) ELSE 0 END + CASE WHEN code IS NULL THEN 0 ELSE 5 + 5 + 4 END) AS n FROM h WHERE place <= 5 GROUP BY query)
    SELECT query, floor(n / 4.0 + 0.5)::BIGINT AS pack, greatest(floor(chars / 4.0 + 0.5) - floor(n / 4.0 + 0.5), 0)::BIGINT AS saved FROM p JOIN b USING (query)""")
def z11_pack_savings(spark, sf_dir):
    from pyspark.sql.window import Window

    h = docs(spark, sf_dir).select(F.col("source").alias("query"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), F.lit("t").alias("title"), F.concat("path", F.lit(", other")).alias("pointer"), F.col("body").alias("snippet"), F.when(doc() % 2 == 0, "x = 1").alias("code"))
    b = docs(spark, sf_dir).groupBy(F.col("source").alias("query")).agg(F.sum(F.length("body")).alias("chars"))
    return reports.pack_savings(h, b, "head")


@register("z12_rules_by_file", "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(scope, '/', source) END AS file FROM docs ORDER BY doc_id LIMIT 40) SELECT file, string_agg(concat('rule ', doc_id), '|' ORDER BY doc_id) AS rules FROM r GROUP BY file")
def z12_rules_by_file(spark, sf_dir):
    r = docs(spark, sf_dir).select(doc().alias("place"), F.when(doc() % 4 == 0, "general").otherwise(F.concat("scope", F.lit("/"), "source", F.lit("#f"), doc().cast("string"))).alias("symbol"), F.concat(F.lit("rule "), doc().cast("string")).alias("rule"))
    return reports.rules_by_file(r).select("file", F.array_join("rules", "|").alias("rules"))


@register("z15_go_modules", "SELECT concat('ex.org/', path) AS module, path AS dir FROM docs WHERE doc_id % 3 = 0")
def z15_go_modules(spark, sf_dir):
    text = F.when(doc() % 3 == 0, F.concat(F.lit("// all\n  module ex.org/"), "path", F.lit("\n\ngo 1.22\n"))).otherwise(F.lit("go 1.22\n"))
    return resolve.go_modules(docs(spark, sf_dir).select(F.concat("path", F.when(doc() % 2 == 0, "/go.mod").otherwise("/go.mod")).alias("path"), text.alias("text")))


@register("z23_call_quotes", r"WITH l AS (SELECT s.id, span_start + i - 1 AS line, string_split(body, chr(10))[span_start + i - 1] AS text FROM spans s JOIN docs d USING (path), (SELECT unnest(range(1, 9)) AS i) WHERE doc_id % 3 <> 0 AND span_start + i - 1 <= least(span_end, len(string_split(body, chr(10))))) SELECT id, min(line)::BIGINT AS line, trim(arg_min(text, line), ' ') AS quote FROM l WHERE regexp_matches(text, '\bthe\b') GROUP BY id")
def z23_call_quotes(spark, sf_dir):
    d = docs(spark, sf_dir)
    hits = view(spark, sf_dir, "spans").join(d.select("path", (doc() % 3).alias("r")), "path").select("id", "path", F.lit("the").alias("name"), F.when(F.col("r") == 0, 2).otherwise(1).alias("depth"), "span_start", "span_end")
    return reports.call_quotes(hits, d.select("path", "body"))


# resolution: raw edges and nodes made from keys

NODE = ("id", "name", "kind", "path", "owner", "language", "arity", "variadic")
RAW = ("edge", "source", "relation", "file", "language", "target_id", "specifier", "name", "via_member", "recv_type", "arg_count")
TYPES = {"edge": "bigint", "via_member": "boolean", "variadic": "boolean", "arity": "int", "arg_count": "int"}


def made(rows, names, **columns):
    """Rows of the given columns, null but for those named."""
    return rows.select(*[columns.get(n, F.lit(None)).cast(TYPES.get(n, "string")).alias(n) for n in names])


def s(x):
    return x.cast("string")


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))


@register("r3_bare_names", """WITH n AS (SELECT p_partkey AS id, concat('fn', p_partkey // 3) AS name, concat('f', p_partkey % 50) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'python' END AS language, p_partkey % 4 AS arity FROM part),
    r AS (SELECT o_orderkey AS edge, concat('f', o_orderkey % 60) AS file, CASE o_orderkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' END AS language, concat('fn', o_custkey % 600) AS name, o_orderkey % 5 AS argc FROM orders),
    c AS (SELECT edge, id, path = file AS own, argc = arity AS fits FROM r JOIN n USING (name) WHERE r.language IS NULL OR r.language = n.language),
    b AS (SELECT edge, bool_or(own) AS own FROM c GROUP BY edge),
    d AS (SELECT c.edge, c.id, c.fits, b.own FROM c JOIN b ON b.edge = c.edge AND b.own = c.own),
    f AS (SELECT edge, own, count(*) AS n, min(id) AS id, sum(fits::INT) AS m, min(CASE WHEN fits THEN id END) AS fit FROM d GROUP BY ALL)
    SELECT edge, concat('n', coalesce(fit, id)) AS target, CASE WHEN own THEN 'extracted' ELSE 'inferred' END AS confidence FROM f WHERE m = 1 OR (m = 0 AND n = 1)""")
def r3_bare_names(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    nodes = made(n, NODE, id=F.concat(F.lit("n"), s(p)), name=F.concat(F.lit("fn"), s(F.floor(p / 3))), kind=F.lit("function"), path=F.concat(F.lit("f"), s(p % 50)), language=F.when(p % 2 == 0, "go").otherwise("python"), arity=p % 4)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    raw = made(o, RAW, edge=key, file=F.concat(F.lit("f"), s(key % 60)), language=F.when(key % 3 == 0, "go").when(key % 3 == 1, "python"), name=F.concat(F.lit("fn"), s(F.col("o_custkey") % 600)), arg_count=key % 5)
    return resolve.bare_names(raw, nodes)


@register("r5_trait_members", "SELECT p_partkey::BIGINT AS edge, CASE WHEN p_partkey % 4 = 0 THEN concat('C', p_partkey, '.log') ELSE concat('T', p_partkey % 5, '.log') END AS target, CASE WHEN p_partkey % 4 = 0 THEN 'extracted' ELSE 'inferred' END AS confidence FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 <> 0")
def r5_trait_members(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    own, trait = F.concat(F.lit("C"), s(p)), F.concat(F.lit("T"), s(p % 5))
    method = {"name": F.lit("log"), "kind": F.lit("method"), "language": F.lit("php")}
    nodes = made(n.where("k % 4 = 0"), NODE, id=F.concat(own, F.lit(".log")), owner=own, path=F.concat(own, F.lit(".php")), **method).unionByName(made(n, NODE, id=F.concat(trait, F.lit(".log")), owner=trait, path=F.lit("t.php"), **method).distinct())
    traits = n.select(own.alias("owner"), trait.alias("trait")).unionByName(n.where("k % 3 = 0").select(own.alias("owner"), F.concat(F.lit("T"), s((p + 1) % 5)).alias("trait")))
    raw = made(n, RAW, edge=p, file=F.concat(own, F.lit(".php")), language=F.lit("php"), name=F.lit("log"), via_member=F.lit(True), recv_type=own)
    return resolve.typed_members(raw, nodes, n.select(own.alias("owner"), F.lit("Nothing").alias("parent")), traits)


@register("r6_relative_imports", "SELECT doc_id::BIGINT AS edge, concat(path, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.py' END) AS target FROM docs")
def r6_relative_imports(spark, sf_dir):
    d = docs(spark, sf_dir)
    made_from = d.select(F.concat("path", F.when(doc() % 3 == 0, ".ts").when(doc() % 3 == 1, "/index.ts").otherwise(".py")).alias("path"))
    more = d.where("doc_id % 3 = 0").select(F.concat("path", F.lit("/index.ts")).alias("path"))  # the nearer spelling wins
    near, far = F.concat(F.lit("./doc"), s(doc())), F.concat(F.lit(".././"), "source", F.lit("/doc"), s(doc()))
    raw = made(d, RAW, edge=doc(), file=F.concat("scope", F.lit("/"), "source", F.lit("/x.ts")), language=F.lit("typescript"), specifier=F.when(doc() % 2 == 0, near).otherwise(far))
    return resolve.relative_imports(raw, made_from.unionByName(more))


@register("r7_java_imports", "SELECT p_partkey::BIGINT AS edge, concat('m', p_partkey % 4, '/com/p', p_partkey, '/T.java') AS target FROM part WHERE p_partkey % 5 <> 0")
def r7_java_imports(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    tail = F.concat(F.lit("/com/p"), s(p), F.lit("/T.java"))
    found = n.select(F.concat(F.lit("m"), s(p % 4), tail).alias("path")).unionByName(n.where("k % 5 = 0").select(F.concat(F.lit("twin"), tail).alias("path")))
    raw = made(n, RAW, edge=p, language=F.lit("java"), specifier=F.concat(F.lit("com.p"), s(p), F.when(p % 3 == 0, ".T.Inner").otherwise(".T")))
    return resolve.java_imports(raw, found)


@register("r8_c_includes", "SELECT p_partkey::BIGINT AS edge, CASE WHEN p_partkey % 3 = 0 THEN concat('src/d', p_partkey % 9, '/h', p_partkey, '.h') ELSE concat('inc/h', p_partkey, '.h') END AS target FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 <> 0")
def r8_c_includes(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    name = F.concat(F.lit("h"), s(p), F.lit(".h"))
    found = n.select(F.concat(F.lit("inc/"), name).alias("path")).unionByName(n.where("k % 3 = 0").select(F.concat(F.lit("src/d"), s(p % 9), F.lit("/"), name).alias("path"))).unionByName(n.where("k % 5 = 0").select(F.concat(F.lit("old/"), name).alias("path")))
    raw = made(n, RAW, edge=p, file=F.concat(F.lit("src/d"), s(p % 9), F.lit("/main.c")), language=F.lit("c"), specifier=name)
    return resolve.c_includes(raw, found)


@register("r9_php_uses", "SELECT p_partkey::BIGINT AS edge, concat('app/N', p_partkey % 8, '/K', p_partkey, '.php') AS target FROM part WHERE p_partkey % 6 <> 0")
def r9_php_uses(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    tail = F.concat(F.lit("/N"), s(p % 8), F.lit("/K"), s(p), F.lit(".php"))
    found = n.select(F.concat(F.lit("app"), tail).alias("path")).unionByName(n.where("k % 6 = 0").select(F.concat(F.lit("lib"), tail).alias("path")))
    raw = made(n, RAW, edge=p, language=F.lit("php"), specifier=F.concat(F.lit("Vendor\\N"), s(p % 8), F.lit("\\K"), s(p)))
    return resolve.namespace_imports(raw, found, r"\\", ".php")


@register("r10_rust_uses", "WITH n AS (SELECT p_partkey AS k FROM part) SELECT k::BIGINT AS edge, CASE WHEN k % 7 = 0 THEN concat('c', k % 10, '/src/lib.rs') ELSE concat('c', k % 10, '/src/m', k + 10, CASE WHEN (k + 10) % 4 = 0 THEN '/mod.rs' ELSE '.rs' END) END AS target FROM n WHERE k % 7 = 0 OR (k % 11 <> 0 AND k + 10 IN (SELECT k FROM n))")
def r10_rust_uses(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    root = F.concat(F.lit("c"), s(p % 10), F.lit("/src/"))
    found = n.select(F.concat(root, F.lit("m"), s(p), F.when(p % 4 == 0, "/mod.rs").otherwise(".rs")).alias("path")).unionByName(n.select(F.concat(root, F.lit("lib.rs")).alias("path")))
    use = F.when(p % 7 == 0, F.lit("crate::Item")).when(p % 11 == 0, F.concat(F.lit("crate::m"), s(p + 1), F.lit("::Item"))).otherwise(F.concat(F.lit("crate::m"), s(p + 10), F.lit("::Item")))
    return resolve.rust_uses(made(n, RAW, edge=p, file=F.concat(root, F.lit("m"), s(p), F.lit(".rs")), language=F.lit("rust"), specifier=use), found)


@register("r11_go_imports", "SELECT p_partkey::BIGINT AS edge, concat('s', p_partkey % 6, '/pkg/d', p_partkey, '/a.go') AS target FROM part")
def r11_go_imports(spark, sf_dir):
    n = parts(spark, sf_dir)
    p = F.col("k")
    at = F.concat(F.lit("s"), s(p % 6), F.lit("/pkg/d"), s(p))
    found = n.select(F.explode(F.array(F.concat(at, F.lit("/b.go")), F.concat(at, F.lit("/a.go")), F.concat(at, F.lit("/A.txt")))).alias("path"))
    modules = n.select(F.concat(F.lit("ex.org/s"), s(p % 6)).alias("module"), F.concat(F.lit("s"), s(p % 6)).alias("dir")).distinct().unionByName(n.limit(1).select(F.lit("ex.org").alias("module"), F.lit("none").alias("dir")))
    return resolve.go_imports(made(n, RAW, edge=p, language=F.lit("go"), specifier=F.concat(F.lit("ex.org/"), at)), found, modules)


# parts that other queries share, each by itself

scalars("p3_only_dirs", "docs", {"kept": (lambda: T.path_under(F.col("path"), F.lit("en/web")) | T.path_under(F.col("path"), F.col("path")) & (doc() % 2 == 0) | T.path_under(F.col("path"), F.lit("f")), "starts_with(path, 'en/web/') OR doc_id % 2 = 0")})
scalars("p7_test_factor", "docs", {
    "plain": (lambda: T.test_factor(F.concat("path", turn_of("/tests/x", "_test.go", "/attest.py", "/test_a.py", ".spec.ts"))), "CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0.35 END::DOUBLE"),
    "asked": (lambda: T.test_factor(F.concat("path", F.lit("/tests/x")), True), "1.0::DOUBLE"),
})
scalars("p14_bots", "docs", {"bot": (lambda: T.is_bot(turn_of("Ann", "dependabot[bot]", "renovate", "Bob", "Robot"), turn_of("a@x.org", "d@x.org", "r@x.org", "1+bot[bot]@users.example", "bot@x.org")), "doc_id % 5 IN (1, 2, 3)")})
scalars("s4_decode", "docs", {"digest": (lambda: F.md5(files.decode(F.when(doc() % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("body", "UTF-8"))).when(doc() % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("body", "UTF-16LE"))).when(doc() % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("body", "UTF-16BE"))).otherwise(F.encode("body", "UTF-8"))).cast("binary")), "CASE WHEN doc_id % 4 <> 2 THEN md5(body) END")})


@register("s10_saved_index", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS lexical, array_to_string(terms, ',') AS terms FROM lex")
def s10_saved_index(spark, sf_dir):
    """The ranking by a saved index: a query opens its terms' buckets and no text."""
    path = f"{shared_folder(spark)}/index/{uuid.uuid4().hex[:12]}"
    retrieval.build_index(docs(spark, sf_dir)).save(path)
    hit = retrieval.lexical(retrieval.Index.load(spark, path), QUERY, docs(spark, sf_dir))
    return hit.select("id", F.round("lexical", 6).alias("lexical"), F.array_join("terms", ",").alias("terms"))


@register("k12_newest_versions", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM docs) WHERE n <= 2")
def k12_newest_versions(spark, sf_dir):
    return files.keep_newest(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 2)


@register("k4_top_hits", "SELECT id, length(body) AS score FROM docs ORDER BY score DESC, id LIMIT 8")
def k4_top_hits(spark, sf_dir):
    return retrieval.top_hits(docs(spark, sf_dir).select("id", F.length("body").alias("score")))


@register("x13_once_only", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def x13_once_only(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("g6_file_walk", _walk("target", "source", 2, "path = 'geo/ASIA'"))
def g6_file_walk(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    return graph.walk(e, graph.file_seeds(n, "geo/ASIA"), 2, "in")


@register("z24_walk_savings", f"WITH s AS (SELECT id, path FROM nodes WHERE name = 'customer8'), p AS (SELECT path FROM s UNION SELECT n.path FROM edges e JOIN s ON e.target = s.id JOIN nodes n ON n.id = e.source WHERE relation IN {WALK}) SELECT count(*) AS files, floor(coalesce(sum(chars), 0) / 4.0 + 0.5)::BIGINT AS baseline_tokens, greatest(floor(coalesce(sum(chars), 0) / 4.0 + 0.5) - 30, 0)::BIGINT AS saved_tokens FROM nodes WHERE kind = 'file' AND path IN (SELECT path FROM p)")
def z24_walk_savings(spark, sf_dir):
    n, e = nodes_edges(spark, sf_dir)
    own = n.where("name = 'customer8'")
    ends = graph.walk(e, own.select("id"), 1, "in").select("id").join(n, "id").select("path")
    return drift.savings(own.select("path").unionByName(ends), n.where("kind = 'file'"), F.lit(30))


@register("u7_deleted_concepts", "SELECT id FROM committed EXCEPT SELECT id FROM current_files")
def u7_deleted_concepts(spark, sf_dir):
    return drift.drift(view(spark, sf_dir, "committed").select("id", F.lit("").alias("hash")), view(spark, sf_dir, "current_files").select("id", F.lit("").alias("hash"))).where("state = 'removed'").select("id")
