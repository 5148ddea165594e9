"""The session, queue and turn behaviours over streams.

Late rows: all jobs with event time take a watermark; rows behind it are dropped by Spark. Sinks that must not repeat
themselves are written by batch number. These are extensions: the batch forms define the results, and the tests hold
each stream against its batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quarrygraph import schema
from quarrygraph.operators import sessions
from quarrygraph.plans.shared import shared_folder


def event_stream(spark: SparkSession, path: str, of: StructType = schema.EVENTS, files_per_batch: int = 8) -> DataFrame:
    rows = spark.readStream.schema(of).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows  # event time has a zone


def closed_sessions(events: DataFrame, hours: int = sessions.IDLE_HOURS, late: str = "10 minutes") -> DataFrame:
    """Sessions closed by inactivity, each once, when the watermark passes their end. Append mode."""
    rows = events.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", f"{hours} hours").alias("s")).agg(F.count("*").alias("events"), F.max("ts").alias("end"))
    return out.select("user_id", F.col("s.start").alias("start"), "end", "events")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def once_per_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def admitted(events: DataFrame) -> DataFrame:
    return sessions.admitted(events).where("skip is null").drop("skip")


def running_counters(events: DataFrame) -> DataFrame:
    """``(user_id, events, clicks, last_event)`` after each batch, from a state of one row a user. Update mode."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, clicks, last = state.get if state.exists else (0, 0, -1)
        for pdf in frames:
            n += len(pdf)
            clicks += int((pdf["event_type"] == "click").sum())
            last = max(last, int(pdf["event_id"].max()))
        state.update((n, clicks, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "clicks": [clicks], "last_event": [last]})

    out = "user_id bigint, events bigint, clicks bigint, last_event bigint"
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, out, "events bigint, clicks bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def novelty_gate(pointers: DataFrame, remember: int = sessions.REMEMBER) -> DataFrame:
    """Rows whose pointer isn't among the last ``remember`` of their session, from a bounded list a session. Append
    mode; ``pointers(session, seq, pointer)``."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        keep = []
        for p in rows["pointer"]:
            keep.append(p not in seen)
            seen = [*seen, p][-remember:]
        state.update((seen,))
        yield rows[keep][["session", "seq", "pointer"]]

    return pointers.select("session", "seq", "pointer").groupBy("session").applyInPandasWithState(step, "session string, seq bigint, pointer string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def latest_per_key(items: DataFrame, path: str, key: str = "key", order: str = "ts") -> Any:
    """A query that keeps each key's latest item in a table of versions: a batch reads the version before it and writes
    its own, so a batch that runs again after a failure gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if number > 0:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}")
            both = old.unionByName(fresh)
            fresh = both.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        fresh.write.mode("overwrite").parquet(f"{path}/v={number}")

    return items.writeStream.foreachBatch(merge)


def run_all(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it gave, for tests and reports: each batch is written by its
    number to the shared folder, so nothing gathers on the driver and a batch that runs again replaces itself. In
    complete mode only the last batch counts."""
    folder = f"{shared_folder(stream.sparkSession)}/streams/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        at = "all" if mode == "complete" else f"b{number}"
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{at}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    spark = stream.sparkSession
    path = f"{folder}/rows/all" if mode == "complete" else f"{folder}/rows/*"
    try:
        return spark.read.schema(stream.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)  # no rows at the source, so no batch


def drain_queue(spark: SparkSession, path: str, state: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Gives ``sink(batch, number)`` the events of a queue that no earlier call took; broken lines are skipped. ``state``
    remembers what was taken. A batch whose sink fails isn't taken: the next call gives it again, under its number."""
    events = spark.readStream.schema(schema.QUEUE_EVENT).option("mode", "DROPMALFORMED").json(path)
    q = events.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
