"""Interval joins: a point in the innermost span, changed ranges over spans, and search grouped by enclosing span.

Spark has no range join, so the line or range is joined to the spans of its path by equality and filtered; where paths
have many spans, both sides are dealt into bins of lines first, which bounds what a path's rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import in_degree

#: Lines of a bin.
BIN = 64


def explode_lines(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """``(path, line, text)`` with lines numbered from 1."""
    return docs.select(F.col(path).alias("path"), F.posexplode(F.split(body, "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def matching_lines(docs: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False) -> DataFrame:
    """Lines that match a pattern; texts without any match are dropped before they are split."""
    import re

    wanted = ("(?i)" if ignore_case else "") + (re.escape(pattern) if literal else pattern)
    some = docs.where(F.col("body").rlike("(?m)" + wanted))
    return explode_lines(some).where(F.col("text").rlike(wanted))


def _binned(spans: DataFrame) -> DataFrame:
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("span_start") / BIN), F.floor(F.col("span_end") / BIN))))


def innermost(points: DataFrame, spans: DataFrame, by: str = "start") -> DataFrame:
    """``points(path, line, ...)`` with ``id`` of the innermost span of ``spans(path, id, span_start, span_end)``, or
    null: the greatest start (``by='start'``, ties by the later id) or the least width (``by='width'``)."""
    keyed = points.withColumn("bin", F.floor(F.col("line") / BIN)).withColumn("__point", F.struct(*points.columns))
    inside = _binned(spans.select("path", "id", "span_start", "span_end"))
    hit = keyed.select("path", "line", "bin").distinct().join(inside, ["path", "bin"]).where("line between span_start and span_end")
    order = F.struct("span_start", "id") if by == "start" else F.struct((F.col("span_start") - F.col("span_end")).alias("w"), "id")
    best = hit.groupBy("path", "line").agg(F.max_by("id", order).alias("id"))
    return points.join(best, ["path", "line"], "left")


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """``(path, range_start, range_end, id, span_start, span_end)`` of ranges that share a line with a span."""
    a = ranges.select("path", "range_start", "range_end").distinct()
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("range_start") / BIN), F.floor(F.col("range_end") / BIN))))
    hit = a.join(_binned(spans.select("path", "id", "span_start", "span_end")), ["path", "bin"]).where("span_start <= range_end and span_end >= range_start")
    return hit.drop("bin").distinct()


def changed_symbols(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """``(path, id)``: spans that overlap a range and contain no other overlapping span of it. Equal spans exclude each
    other."""
    hit = overlapping(ranges, spans)
    o = hit.select("path", "range_start", "range_end", F.col("id").alias("other"), F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    same = ["path", "range_start", "range_end"]
    inner = hit.join(o, same).where("other <> id and s >= span_start and e <= span_end").select(*same, "id").distinct()
    return hit.join(inner, [*same, "id"], "left_anti").select("path", "id").distinct()


def search(docs: DataFrame, spans: DataFrame, edges: DataFrame | None, pattern: str, cap: int = 300, **options) -> DataFrame:
    """``(path, id, lines, first_line, degree)``: matches grouped by innermost span, most coupled first; ``cap`` keeps
    the first matches in order of path and line."""
    hits = matching_lines(docs, pattern, **options).orderBy("path", "line").limit(cap)
    grouped = innermost(hits, spans).groupBy("path", "id").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))
    if edges is None:
        return grouped.withColumn("degree", F.lit(0).cast("bigint"))
    return grouped.join(in_degree(edges), "id", "left").select("path", "id", "lines", "first_line", F.coalesce("degree", F.lit(0)).alias("degree"))


def overflow(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """One row ``(kept, dropped)`` for a cap of so many rows in order."""
    n = rows.agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("bigint").alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).cast("bigint").alias("dropped"))


def residual_lines(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(path, line, text)`` of the lines that no span covers."""
    inside = _binned(spans.select("path", "span_start", "span_end"))
    lines = explode_lines(docs).withColumn("bin", F.floor(F.col("line") / BIN))
    covered = lines.select("path", "line", "bin").join(inside, ["path", "bin"]).where("line between span_start and span_end").select("path", "line").distinct()
    return lines.drop("bin").join(covered, ["path", "line"], "left_anti")
