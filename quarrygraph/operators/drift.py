"""Drift detection by key and hash, carry-over of earlier results, digests and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(committed: DataFrame, current: DataFrame, key: str = "id", digest: str = "hash") -> DataFrame:
    """``(key, state)`` with state added, removed, changed or same."""
    a = committed.select(F.col(key), F.col(digest).alias("old"))
    b = current.select(F.col(key), F.col(digest).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def file_drift(prints: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, state)``: files of equal size and time count as unchanged without a look at their hashes."""
    a = prints.select("path", F.col("size").alias("s0"), F.col("mtime").alias("t0"), F.col("hash").alias("h0"))
    b = now.select("path", F.col("size").alias("s1"), F.col("mtime").alias("t1"), F.col("hash").alias("h1"))
    state = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when((F.col("s0") == F.col("s1")) & (F.col("t0") == F.col("t1")), "same").when(F.col("h0") != F.col("h1"), "changed").otherwise("touched")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def carry_over(current: DataFrame, prior: DataFrame) -> DataFrame:
    """``(id, summary_state, reused)``: a ready result of the same hash is reused, one of another hash is stale, and
    what has none is pending."""
    p = prior.select("id", F.col("hash").alias("old"), F.col("summary_state").alias("was"))
    ready = F.col("was") == "ready"
    state = F.when(ready & (F.col("old") == F.col("hash")), "ready").when(ready, "stale").otherwise("pending")
    return current.select("id", "hash").join(p, "id", "left").select("id", F.coalesce(state, F.lit("pending")).alias("summary_state"), F.coalesce(ready & (F.col("old") == F.col("hash")), F.lit(False)).alias("reused"))


def digest(rows: DataFrame, group: str, path: str = "path", hash_: str = "hash") -> DataFrame:
    """``(group, digest)``: SHA-256 over the group's sorted ``path:hash`` lines."""
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", path, hash_))), "\n"), 256).alias("digest"))


def freshness(states: DataFrame) -> DataFrame:
    """One row of counts by state."""
    return states.agg(*[F.sum((F.col("state") == s).cast("bigint")).alias(s) for s in ("added", "removed", "changed", "same")])


def savings(paths: DataFrame, files: DataFrame, emitted: Column) -> DataFrame:
    """One row ``(files, baseline_tokens, saved_tokens)``: what reading the distinct paths whole would cost, against
    ``emitted`` tokens."""
    hit = files.where("chars is not null").join(paths.select("path").distinct(), "path", "left_semi")
    out = hit.agg(F.count("*").alias("files"), F.floor(F.coalesce(F.sum("chars"), F.lit(0)) / 4 + 0.5).cast("bigint").alias("baseline_tokens"))
    return out.withColumn("saved_tokens", F.greatest(F.col("baseline_tokens") - emitted, F.lit(0)).cast("bigint"))


def merge_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows of their key; old keys that aren't new stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
