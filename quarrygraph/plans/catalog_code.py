"""Queries whose inputs are made in code: extraction, resolution, histories and streams. The sources are made by a
template, so SQL knows what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygraph.operators import extract, resolve
from quarrygraph.plans.catalog import register
from quarrygraph.plans.catalog_more import SESSIONS
from quarrygraph.plans.views import view
from quarrygraph.sources import files, history
from quarrygraph.streaming import jobs


def sources_of(spark, sf_dir):
    """A small Python module for each part: a class with a method that calls the module of the part before."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    key = F.col("p_partkey").cast("string")
    before = F.greatest(F.col("p_partkey") - 1, F.lit(1)).cast("string")
    text = F.concat(F.lit("from .mod"), before, F.lit(" import make"), before, F.lit("\n\nclass Part"), key, F.lit(":\n    def run(self, x):\n        return self.step(x)\n\n    def step(self, x):\n        return make"), before, F.lit("(x)\n\ndef make"), key, F.lit("(x):\n    p = Part"), key, F.lit("()\n    return p.run(x)\n"))
    path = F.concat(F.lit("pkg/mod"), key, F.lit(".py"))
    return p.select(path.alias("path"), text.alias("text"), files.language_of(path).alias("language"))


#: What the template of :func:`sources_of` holds, for SQL: its texts and its paths.
MADE = """t AS (SELECT p_partkey AS k, greatest(p_partkey - 1, 1) AS b, concat('pkg/mod', p_partkey, '.py') AS path FROM part),
    m AS (SELECT *, path || '#Part' || k AS cls, path || '#make' || k AS fn, path || '#Part' || k || '.run' AS run, path || '#Part' || k || '.step' AS step,
      '    def run(self, x):' || chr(10) || '        return self.step(x)' AS run_text, '    def step(self, x):' || chr(10) || '        return make' || b || '(x)' AS step_text,
      'def make' || k || '(x):' || chr(10) || '    p = Part' || k || '()' || chr(10) || '    return p.run(x)' AS fn_text FROM t),
    s AS (SELECT *, 'class Part' || k || ':' || chr(10) || run_text || chr(10) || chr(10) || step_text AS cls_text FROM m),
    f AS (SELECT *, 'from .mod' || b || ' import make' || b || chr(10) || chr(10) || cls_text || chr(10) || chr(10) || fn_text || chr(10) AS text FROM s)"""


def _node(id_: str, name: str, kind: str, owner: str, lo: int, hi: int, signature: str, text: str) -> str:
    return f"SELECT {id_} AS id, {name} AS name, '{kind}' AS kind, path, {owner} AS owner, 'python' AS language, {lo} AS span_start, {hi} AS span_end, {signature} AS signature, true AS exported, sha256({text}) AS body_hash FROM f"


NODES_SQL = f"WITH {MADE} " + " UNION ALL ".join([
    _node("path", "path", "file", "NULL", 1, 13, "NULL", "text"), _node("cls", "'Part' || k", "class", "NULL", 3, 8, "'class Part' || k || ':'", "cls_text"),
    _node("run", "'run'", "method", "'Part' || k", 4, 5, "'def run(self, x):'", "run_text"), _node("step", "'step'", "method", "'Part' || k", 7, 8, "'def step(self, x):'", "step_text"),
    _node("fn", "'make' || k", "function", "NULL", 10, 12, "'def make' || k || '(x):'", "fn_text"),
])


def _raw(source: str, relation: str, target: str = "NULL", specifier: str = "NULL", name: str = "NULL", member: str = "NULL", receiver: str = "NULL") -> str:
    return f"SELECT {source} AS source, '{relation}' AS relation, path AS file, 'python' AS language, {target} AS target_id, {specifier} AS specifier, {name} AS name, {member} AS via_member, {receiver} AS recv_type FROM f"


RAW_SQL = f"WITH {MADE} " + " UNION ALL ".join([
    _raw("path", "imports", specifier="'./mod' || b", member="false"), _raw("path", "contains", "cls"), _raw("cls", "contains", "run"), _raw("cls", "contains", "step"), _raw("path", "contains", "fn"),
    _raw("run", "calls", name="'step'", member="true", receiver="'Part' || k"), _raw("step", "calls", name="'make' || b", member="false"), _raw("fn", "calls", name="'Part' || k", member="false"), _raw("fn", "calls", name="'run'", member="true", receiver="'Part' || k"),
])


def _edge(source: str, target: str, relation: str, confidence: str = "'extracted'") -> str:
    return f"SELECT {source} AS source, {target} AS target, '{relation}' AS relation, {confidence} AS confidence FROM f"


EDGES_SQL = f"WITH {MADE} " + " UNION ALL ".join([
    _edge("path", "'pkg/mod' || b || '.py'", "imports"), _edge("path", "cls", "contains"), _edge("cls", "run", "contains"), _edge("cls", "step", "contains"), _edge("path", "fn", "contains"),
    _edge("run", "step", "calls"), _edge("step", "'pkg/mod' || b || '.py#make' || b", "calls", "CASE WHEN b = k THEN 'extracted' ELSE 'inferred' END"), _edge("fn", "cls", "calls"), _edge("fn", "run", "calls"),
])


@register("e1_extract_nodes", NODES_SQL)
def e1_extract_nodes(spark, sf_dir):
    return extract.extract_nodes(sources_of(spark, sf_dir)).drop("arity", "variadic")


@register("e4_extract_raw_edges", RAW_SQL)
def e4_extract_raw_edges(spark, sf_dir):
    return extract.extract_raw_edges(sources_of(spark, sf_dir)).drop("arg_count")


@register("r1_resolve", EDGES_SQL)
def r1_resolve(spark, sf_dir):
    nodes, raw = extract.extract_both(sources_of(spark, sf_dir))
    none = spark.createDataFrame([], "owner string, parent string")
    return resolve.resolve(raw, nodes, none)


@register("s15_parse_patches", "SELECT path, (doc_id % 90 + 1)::INT AS range_start, (doc_id % 90 + doc_id % 4 + 1)::INT AS range_end FROM docs")
def s15_parse_patches(spark, sf_dir):
    d = view(spark, sf_dir, "docs")
    start, extra = (F.col("doc_id") % 90 + 1).cast("string"), (F.col("doc_id") % 4 + 1).cast("string")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/"), F.col("path"), F.lit("\n@@ -1 +"), start, F.lit(","), extra, F.lit(" @@\n+x\n"))
    return history.parse_patches(d.select(text.alias("text")))


@register("s16_parse_log", "SELECT hash, author, email, concat(area, '.py') AS path FROM commits")
def s16_parse_log(spark, sf_dir):
    c = view(spark, sf_dir, "commits")
    text = F.concat(F.lit("\x01"), "hash", F.lit("\x022024-01-01T00:00:00Z\x02"), "author", F.lit("\x02"), "email", F.lit("\n\n"), "area", F.lit(".py\n"))
    return history.parse_log(c.select(text.alias("text"))).select("hash", "author", "email", "path")


@register("s6_languages", "SELECT path, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' END AS language, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'native' END AS class FROM docs")
def s6_languages(spark, sf_dir):
    k = F.col("doc_id") % 4
    name = F.concat("path", F.when(k == 0, ".py").when(k == 1, ".tsx").when(k == 2, ".GO").otherwise(".txt"))
    return view(spark, sf_dir, "docs").select("path", files.language_of(name).alias("language"), files.classify(name, F.lit("")).alias("class"))


@register("x1_closed_sessions_stream", f"WITH {SESSIONS} SELECT user_id, floor(epoch(start))::BIGINT AS start, floor(epoch(last))::BIGINT AS finish, events FROM s WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts)::TIMESTAMP - INTERVAL 10 MINUTE FROM events)")
def x1_closed_sessions_stream(spark, sf_dir):
    """The stream's sessions; the last ones stay open until later rows come."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    closed = jobs.run_all(jobs.closed_sessions(rows.withColumn("ts", F.col("ts").cast("timestamp"))), "closed_sessions_query")
    return closed.select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("finish"), "events")
