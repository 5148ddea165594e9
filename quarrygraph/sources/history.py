"""Diffs and commit logs: text in, rows out. The texts are arrays of lines of one command's output, so the parsers are
expressions over exploded lines, with a running count of headers as the key that ties a line to its header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_name_status(lines: DataFrame) -> DataFrame:
    """``(path, status, old_path)`` of ``lines(text)``, one status line a row, fields split by tabs."""
    f = F.split("text", "\t")
    kind = F.substring(F.get(f, F.lit(0)), 1, 1)
    named = F.create_map(*[F.lit(x) for pair in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}.items() for x in pair])
    moved = kind.isin("R", "C")
    out = lines.where(F.col("text").rlike("^[AMDRCT][0-9]*\t"))
    return out.select(F.when(moved, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), F.try_element_at(named, kind).alias("status"), F.when(moved, F.get(f, F.lit(1))).alias("old_path"))


def parse_patches(patches: DataFrame) -> DataFrame:
    """``(path, range_start, range_end)`` of ``patches(text)``: each a whole patch without context lines. A hunk that
    adds nothing is the single line before it, line 1 at least; deleted files have no ranges."""
    files = patches.select(F.explode(F.split("text", r"(?m)^diff --git ")).alias("part")).where(F.col("part") != "")
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(.*)$", 1)
    hunks = F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\S+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))
    rows = files.select(path.alias("path"), F.explode(hunks).alias("h")).where((F.col("path") != "") & (F.col("path") != "/dev/null"))
    start = F.get(F.split("h", ","), F.lit(0)).cast("int")
    count = F.coalesce(F.get(F.split("h", ","), F.lit(1)).cast("int"), F.lit(1))
    low = F.greatest(start, F.lit(1))
    return rows.select("path", low.alias("range_start"), F.when(count == 0, low).otherwise(start + count - 1).alias("range_end"))


def parse_log(logs: DataFrame) -> DataFrame:
    """``(hash, made_at, author, email, path)`` of ``logs(text)``: commits that begin with byte 1 and have their fields
    split by byte 2, then the names of their files."""
    commits = logs.select(F.explode(F.split("text", "\x01")).alias("c")).where(F.col("c") != "")
    head = F.split(F.substring_index("c", "\n", 1), "\x02")
    names = F.filter(F.slice(F.split("c", "\n"), 2, 1 << 30), lambda x: x != "")
    rows = commits.select(F.get(head, F.lit(0)).alias("hash"), F.try_to_timestamp(F.get(head, F.lit(1))).alias("made_at"), F.get(head, F.lit(2)).alias("author"), F.get(head, F.lit(3)).alias("email"), F.explode(names).alias("path"))
    return rows.where("made_at is not null")
