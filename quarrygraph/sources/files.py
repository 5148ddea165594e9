"""Source trees, graphs, indexes, concepts, transcripts and queues: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph import schema
from quarrygraph.functions import text as T

#: Largest source file, directories that hold no sources, bytes read to classify a file.
MAX_BYTES, PREFIX_BYTES = 1 << 20, 8192
SKIPPED = ("node_modules", "dist", "build", "out", "target", "vendor", "coverage", "__pycache__", "venv", ".git")
#: Fixed table of extensions and languages, the first of a pair for the second.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "java": "java", "kt": "kotlin", "swift": "swift", "php": "php", "r": "r", "rb": "ruby",
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "scala": "scala", "lua": "lua",
    "sh": "bash", "vue": "vue", "pl": "perl", "pm": "perl",
}


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """``(path, size, mtime, content)`` of the files below ``root`` that may be sources: at most 1 MiB, in no hidden or
    build directory, and with ``include`` below one of these prefixes."""
    import re

    base = root.rstrip("/").split("://")[-1] + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BYTES)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base), "")
    out = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    out = out.where(~F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda d: d.startswith(".") | d.isin(*SKIPPED)))
    if include:
        keep = F.lit(False)
        for prefix in include:
            keep = keep | T.path_under(F.col("path"), F.lit(prefix))
        out = out.where(keep)
    return out


def decode(content: Column) -> Column:
    """UTF-8, or UTF-16 little endian by its mark; null for UTF-16 big endian."""
    mark = F.hex(F.substring(content, 1, 3))
    little = F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")
    return F.when(mark.startswith("FEFF"), F.lit(None)).when(mark.startswith("FFFE"), little).when(mark == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).otherwise(F.decode(content, "UTF-8"))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def classify(path: Column, prefix: Column) -> Column:
    """native, container, perl, generic or null: by extension, else by the first line of the file."""
    language = language_of(path)
    shebang = F.regexp_extract(F.substring_index(prefix, "\n", 1), r"^#!.*?\b(python|perl|node|bash|sh)[0-9.]*\b", 1)
    return (
        F.when(language == "vue", "container")
        .when((language == "perl") | (shebang == "perl"), "perl")
        .when(language.isin("typescript", "javascript", "python", "go", "java", "kotlin", "swift", "php", "r"), "native")
        .when(language.isNotNull() | (shebang != ""), "generic")
    )


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document in JSON; what is missing or malformed gives no rows."""
    doc = spark.read.schema(schema.GRAPH_JSON).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Sorted node and edge tables without body texts. Range partitions are sorted each, so files are in order and no
    task sorts all rows; the committer makes each table appear at once."""
    nodes.drop("body_text").orderBy("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.orderBy("source", "relation", "target").write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def fingerprint(files: DataFrame) -> DataFrame:
    return files.select("path", "size", F.col("mtime").cast("double").alias("mtime"), F.sha2("content", 256).alias("hash"))


def keep_newest(entries: DataFrame, key: str, mtime: str, keep: int = 2) -> DataFrame:
    """The newest versions of each entry."""
    return entries.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(mtime).desc()))).where(F.col("n") <= keep).drop("n")


def read_concepts(spark: SparkSession, root: str) -> DataFrame:
    """``(slug, name, type, summary, body)`` of the markdown files below ``root`` but for the index."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.input_file_name().alias("file"), "value")
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    slug = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    return raw.where(slug != "INDEX").select(slug.alias("slug"), F.coalesce(field("name"), slug).alias("name"), field("type").alias("type"), field("summary").alias("summary"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("body"))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines; lines that aren't JSON are dropped."""
    return spark.read.schema(schema.TRANSCRIPT).option("mode", "DROPMALFORMED").json(path)


def last_assistant_turn(lines: DataFrame) -> DataFrame:
    """``(id, model, input_tokens, cache_write, cache_read)``: the assistant's messages of the main thread, each once."""
    rows = lines.where("type = 'assistant' and not coalesce(isSidechain, false) and not coalesce(isMeta, false)").select("message.*")
    return rows.groupBy("id").agg(F.max("model").alias("model"), F.max("usage.input_tokens").alias("input_tokens"), F.max("usage.cache_creation_input_tokens").alias("cache_write"), F.max("usage.cache_read_input_tokens").alias("cache_read"))


def enqueue(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def peek(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.QUEUE_EVENT).option("mode", "DROPMALFORMED").json(path)
