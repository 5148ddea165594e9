"""Canonical inputs over the test tables, in SQL that Spark and DuckDB both read.

The graph holds a file node for each path and a symbol node for each entity; the documents are a text corpus with a
path and a scope each. Queries and their oracles share these definitions and nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")

_NATION_PATH = "concat('geo/', r_name, '/', n_name)"


def _entity(name: str, key: str, kind: str, path: str, language: str, source: str) -> str:
    return f"""
      SELECT {key} AS k, concat({path}, '#{name}', {key}) AS id, concat('{name}', {key}) AS name, '{kind}' AS kind, {path} AS path, '{language}' AS language FROM {source}"""


VIEWS = {
    "region_ids": _entity("region", "r_regionkey", "module", "concat('geo/', r_name)", "sql", "region"),
    "nation_ids": _entity("nation", "n_nationkey", "class", _NATION_PATH, "sql", "nation JOIN region ON r_regionkey = n_regionkey"),
    "customer_ids": _entity("customer", "c_custkey", "class", "concat('crm/', c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '/tests/case' ELSE '/main' END)", "go", "customer"),
    "supplier_ids": _entity("supplier", "s_suppkey", "class", "concat('supply/s', s_suppkey % 7)", "java", "supplier"),
    "part_ids": _entity("part", "p_partkey", "function", "concat('catalog/', p_brand, '/', p_size)", "python", "part"),
    "order_ids": _entity("order", "o_orderkey", "method", "concat('sales/', o_orderstatus, '/', o_orderkey % 16)", "python", "orders"),
    "symbols": " UNION ALL ".join(f"SELECT id, name, kind, path, language FROM {e}_ids" for e in ("region", "nation", "customer", "supplier", "part", "order")),
    "nodes": """
      SELECT id, name, kind, path, language, CAST(NULL AS BIGINT) AS chars FROM symbols
      UNION ALL SELECT path AS id, path AS name, 'file' AS kind, path, min(language) AS language, CAST(sum(length(id)) AS BIGINT) AS chars FROM symbols GROUP BY path""",
    "edges": """
      SELECT n.id AS source, r.id AS target, 'extends' AS relation FROM nation JOIN nation_ids n ON n.k = n_nationkey JOIN region_ids r ON r.k = n_regionkey
      UNION ALL SELECT c.id, n.id, 'references' FROM customer JOIN customer_ids c ON c.k = c_custkey JOIN nation_ids n ON n.k = c_nationkey
      UNION ALL SELECT s.id, n.id, 'references' FROM supplier JOIN supplier_ids s ON s.k = s_suppkey JOIN nation_ids n ON n.k = s_nationkey
      UNION ALL SELECT o.id, c.id, 'imports' FROM orders JOIN order_ids o ON o.k = o_orderkey JOIN customer_ids c ON c.k = o_custkey
      UNION ALL SELECT o.id, p.id, 'calls' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN order_ids o ON o.k = l_orderkey JOIN part_ids p ON p.k = l_partkey
      UNION ALL SELECT o.id, s.id, 'calls' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l JOIN order_ids o ON o.k = l_orderkey JOIN supplier_ids s ON s.k = l_suppkey
      UNION ALL SELECT o.id, 'ext:R', 'imports' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l JOIN order_ids o ON o.k = l_orderkey
      UNION ALL SELECT path, id, 'contains' FROM symbols""",
    "docs": """
      SELECT doc_id, concat(lang, '/', source, '/doc', doc_id) AS path, concat(lang, '/', source, '/doc', doc_id) AS id, source AS name, lang AS scope, source, text AS body FROM documents""",
    "spans": """
      SELECT path, concat(path, '#outer', k) AS id, 'function' AS kind, k * 8 + 1 AS span_start, k * 8 + 8 AS span_end FROM docs CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks
      UNION ALL SELECT path, concat(path, '#inner', k), 'method', k * 8 + 3, k * 8 + 5 FROM docs CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks""",
    "changes": """
      SELECT path, (doc_id % 5) * 4 + 1 AS range_start, (doc_id % 5) * 4 + 1 + doc_id % 9 AS range_end FROM docs WHERE doc_id % 3 = 0
      UNION ALL SELECT path, 30, 34 FROM docs WHERE doc_id % 21 = 0""",
    "committed": """
      SELECT id, path, body AS text, length(body) AS size, CASE WHEN doc_id % 3 = 0 THEN 'ready' WHEN doc_id % 3 = 1 THEN 'pending' ELSE 'stale' END AS summary_state FROM docs WHERE doc_id % 7 <> 0""",
    "current_files": """
      SELECT id, path, CASE WHEN doc_id % 11 = 0 THEN concat(body, '!') ELSE body END AS text, CASE WHEN doc_id % 11 = 0 THEN length(body) + 1 ELSE length(body) END AS size FROM docs WHERE doc_id % 5 <> 0""",
    "commits": """
      SELECT concat('h', event_id % 4000) AS hash, ts AS made_at, concat('user', user_id) AS author, concat('user', user_id, '@example.com') AS email, event_type AS area FROM events""",
    "scored": """
      SELECT concat(name, '/', doc_id % 50) AS id, scope, min(path) AS path, max(CAST(length(body) % 997 AS DOUBLE) / 997 + doc_id % 13) AS score FROM docs GROUP BY concat(name, '/', doc_id % 50), scope""",
}


def _needs(sql: str) -> list[str]:
    """The views that ``sql`` names, each after those that it names itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def ctes(sql: str) -> str:
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _needs(sql))


def oracle(sql: str) -> str:
    """``sql`` over the views as DuckDB runs it; ``sql`` may begin with further common table expressions, each
    ``name AS (...),``, marked by a leading ``WITH``."""
    body = sql.strip()
    head = ctes(body)
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {head + ',' if head else ''}\n{body[5:]}"
    return f"WITH RECURSIVE {head}\n{body}" if head else body


#: Bytes of the line items for one part of the graph's joins: about a million rows, so a task's memory stays the same.
PART_BYTES = 8 << 20


def _dealt(whole: str, parts: int) -> str:
    """The edges' joins in ``parts`` parts, which only Spark needs to be told: line items are dealt by order once, for
    ``DISTINCT`` and the join with the orders alike, and entities by key, which the other side of their join follows."""
    whole = re.sub(r"\bFROM lineitem\b", f"FROM (SELECT /*+ REPARTITION({parts}, l_orderkey) */ * FROM lineitem)", whole)
    return re.sub(r"\bJOIN (customer|supplier|part|order)_ids (\w)\b", rf"JOIN (SELECT /*+ REPARTITION({parts}, k) */ * FROM \1_ids) \2", whole)


def _bytes(spark: SparkSession, path: str) -> int:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg({"length": "sum"})
    return found.first()[0] or 0


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view as a DataFrame; only the tables that it reads are opened, and the session's own views of such
    names stay as they are."""
    sql = f"SELECT * FROM {name}"
    head = ctes(sql)
    whole = f"WITH {head} {sql}" if head else sql
    if name == "edges":
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _bytes(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES)
        whole = _dealt(whole, parts)
    tables = {}
    for table in TABLES:
        whole, n = re.subn(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", whole)
        if n:
            tables[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(whole, **tables)
