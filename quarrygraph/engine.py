"""The engine: a graph, its index, and the questions asked of it."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import concepts, drift, extract, graph, impact, intervals, resolve, retrieval
from quarrygraph.sources import files


VERSION = "version bigint, work string, stamp string"


def extractor_stamp() -> str:
    """Identity of what turns a file into nodes and raw edges: a digest of the sources it is made of."""
    return hashlib.sha256("\n".join(inspect.getsource(m) for m in (extract, files, T)).encode()).hexdigest()


class Engine:
    """Versions under one folder. Each build writes all its tables, ``tree``, ``nodes``, ``raw``, ``graph`` and ``index``,
    to a folder of its own below ``work/`` and is published by one row appended to ``versions``: a build that fails at
    any point leaves the version before it whole and in use. Of two builds that end with the same number the one whose
    folder sorts last is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> Row | None:
        """``(version, work, stamp)`` of the last published build, or None."""
        try:
            rows = self.spark.read.schema(VERSION).parquet(f"{self.root}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.orderBy(F.desc("version"), F.desc("work")).first()

    def _at(self, name: str) -> str:
        last = self.version()
        if last is None:
            raise ValueError(f"nothing is built at {self.root}")
        return f"{last.work}/{name}"

    def build(self, source: str, include: list[str] | None = None, reuse: bool = False) -> None:
        """Reads a source tree once, extracts and resolves its graph, and publishes it with its index. With ``reuse``
        files whose hash is that of the last build aren't parsed again, if the extractor is the same; names are resolved
        anew over all files."""
        last, stamp = self.version(), extractor_stamp()
        old = last.work if reuse and last is not None and last.stamp == stamp else None
        base = f"{self.root}/work/{uuid.uuid4().hex[:12]}"
        found = files.scan_tree(self.spark, source, include)
        text = files.decode(F.col("content")).alias("text")
        found.select("path", F.sha2("content", 256).alias("hash"), "size", F.col("mtime").cast("double").alias("mtime"), text, files.language_of(F.col("path")).alias("language")).write.parquet(f"{base}/tree")
        texts = self.spark.read.parquet(f"{base}/tree").where("text is not null")
        known = texts.where("language is not null")
        fresh, kept = extract.incremental(known, self.spark.read.parquet(f"{old}/tree")) if old else (known, None)
        nodes, raw = extract.extract_nodes(fresh), extract.extract_raw_edges(fresh)
        if kept is not None:
            same = kept.select("path")
            nodes = nodes.unionByName(self.spark.read.parquet(f"{old}/nodes").drop("chars").join(same, "path", "left_semi"))
            raw = raw.unionByName(self.spark.read.parquet(f"{old}/raw").drop("edge").join(same.withColumnRenamed("path", "file"), "file", "left_semi"))
        sizes = known.select(F.col("path").alias("id"), F.length("text").cast("bigint").alias("chars"))
        nodes = nodes.join(sizes, "id", "left")
        nodes.write.parquet(f"{base}/nodes")
        raw.withColumn("edge", F.monotonically_increasing_id()).write.parquet(f"{base}/raw")  # numbers that must not change after this
        nodes, raw = self.spark.read.parquet(f"{base}/nodes"), self.spark.read.parquet(f"{base}/raw")
        heritage = raw.where("relation in ('extends', 'implements')").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("owner")), "source")
        modules = resolve.go_modules(texts.select("path", "text"))
        edges = resolve.resolve(raw, nodes, heritage.select("owner", F.col("name").alias("parent")).distinct(), modules)
        files.write_graph(nodes, edges, f"{base}/graph")
        spans = nodes.select("id", "name", "path", "span_start", "span_end").join(known.select("path", "text"), "path")
        docs = spans.select("id", "name", "path", T.search_body(T.slice_span(F.col("text"), F.col("span_start"), F.col("span_end"), 1 << 20)).alias("body"))
        retrieval.build_index(docs).save(f"{base}/index")
        row = (last.version + 1 if last else 1, base, stamp)
        self.spark.createDataFrame([row], VERSION).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def refresh(self, source: str, include: list[str] | None = None) -> bool:
        """Builds again if a file was added, removed or changed since the last build, or the extractor was, or nothing
        is built yet, and says whether it did."""
        last = self.version()
        if last is not None and last.stamp == extractor_stamp():
            now = files.fingerprint(files.scan_tree(self.spark, source, include))
            if drift.file_drift(self._prints(), now).where("state not in ('same', 'touched')").isEmpty():
                return False
        self.build(source, include, reuse=True)
        return True

    def _prints(self) -> DataFrame:
        return self.spark.read.parquet(self._at("tree")).select("path", "size", "mtime", "hash")

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(self._at("tree")).where("text is not null and language is not null").select("path", "text")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return files.load_graph(self.spark, self._at("graph"))

    def index(self) -> retrieval.Index:
        return retrieval.Index.load(self.spark, self._at("index"))

    def check(self, source: str) -> DataFrame:
        """State of every file against the last build."""
        now = files.fingerprint(files.scan_tree(self.spark, source))
        return drift.file_drift(self._prints(), now)

    def ask(self, query: str, limit: int = 8) -> DataFrame:
        """``(id, name, path, score)``: neighbours for questions about callers and callees, else the best hits by text
        and graph."""
        nodes, edges = self.graph()
        direction, found = graph.structural(nodes, edges, query, limit)
        if found is not None:
            return found.select("id", "name", "path", F.lit(1.0).alias("score"))
        lexical = retrieval.lexical(self.index(), query, nodes)
        ranks = graph.personalized_pagerank(nodes, edges, lexical.select("id", F.col("lexical").alias("weight")))
        blended = retrieval.blend(lexical, ranks, nodes.select("id", T.test_factor(F.col("path")).alias("factor")))
        top = retrieval.top_hits(blended, limit)
        return top.join(nodes.select("id", "name", "path"), "id").select("id", "name", "path", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "id")

    def grep(self, pattern: str, **options) -> DataFrame:
        nodes, edges = self.graph()
        texts = self._texts().withColumnRenamed("text", "body")
        spans = nodes.where("kind <> 'file'").select("path", "id", "span_start", "span_end")
        return intervals.search(texts, spans, edges, pattern, **options).orderBy(F.col("degree").desc(), "path")

    def map(self, **options) -> DataFrame:
        return graph.repo_map(*self.graph(), **options)

    def callers(self, symbol: str, depth: int | None = 1) -> DataFrame:
        return self._walk(symbol, depth, "in")

    def callees(self, symbol: str, depth: int | None = 1) -> DataFrame:
        return self._walk(symbol, depth, "out")

    def _walk(self, symbol: str, depth: int | None, direction: str) -> DataFrame:
        nodes, edges = self.graph()
        return graph.walk(edges, graph.resolve_symbol(nodes, symbol), depth, direction)

    def skeleton(self, path: str) -> DataFrame:
        """Signatures of one file: its exact path, else the only path with that tail."""
        nodes, _ = self.graph()
        some = nodes.where((F.col("path") == path) | F.col("path").endswith("/" + path))
        names = [r[0] for r in some.select("path").distinct().limit(3).collect()]
        if path not in names and len(names) != 1:
            raise ValueError(f"{path!r} is {'ambiguous' if names else 'unknown'}")
        own = path if path in names else names[0]
        return some.where((F.col("path") == own) & (F.col("kind") != "file")).select("name", "kind", "span_start", "span_end", "signature").orderBy("span_start")

    def blast(self, changed: DataFrame, ranges: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
        """Seeds, impacted symbols, modules and areas of ``changed(path)`` and ``ranges(path, range_start, range_end)``."""
        nodes, edges = self.graph()
        seeds = impact.seeds(changed, ranges, nodes.where("kind <> 'file'").select("path", "id", "span_start", "span_end"), nodes.where("kind = 'file'").select("id", "path"))
        hit = impact.blast(edges, seeds, depth)
        return {"seeds": seeds, "impacted": hit, "modules": impact.modules(hit, nodes, changed), "areas": impact.areas(seeds, nodes, edges, changed)}

    def summarise(self, summary: Callable[[str, str], str]) -> DataFrame:
        """``(id, summary)`` from a function of a symbol's text and path, a file's symbols together. The function stands
        for a language model; there is none here."""
        import pandas as pd

        nodes, _ = self.graph()
        texts = self._texts()
        rows = nodes.where("kind <> 'file'").join(texts, "path").select("id", "path", T.slice_span(F.col("text"), F.col("span_start"), F.col("span_end")).alias("code"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": pdf["id"], "summary": [summary(c, p) for c, p in zip(pdf["code"], pdf["path"], strict=True)]})

        return rows.groupBy("path").applyInPandas(run, "id string, summary string")

    def cards(self) -> DataFrame:
        nodes, _ = self.graph()
        return concepts.cards(nodes, F.col("span_start"))


def text_report(rows: DataFrame, limit: int = 50) -> str:
    """A plain table of the first rows, for people."""
    head = rows.limit(limit).collect()
    return "\n".join(["\t".join(rows.columns), *("\t".join("" if v is None else str(v) for v in r) for r in head)])


def mermaid(edges: DataFrame, limit: int = 60) -> str:
    """A diagram of the first edges in order."""
    rows = edges.select("source", "relation", "target").orderBy("source", "relation", "target").limit(limit).collect()
    names: dict[str, str] = {}
    node = lambda x: names.setdefault(x, f"n{len(names)}")
    lines = [f"  {node(r.source)} -->|{r.relation}| {node(r.target)}" for r in rows]
    return "\n".join(["graph LR", *(f'  {v}["{k}"]' for k, v in names.items()), *lines])
