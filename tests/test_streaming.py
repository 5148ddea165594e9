import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import sessions
from quarrygraph.streaming import jobs


def parts(spark, sf_dir, path, n=4):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    size = events.count() // n + 1
    rows = events.collect()
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(path)
    return events


def test_sessions_equal_their_batch_form(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    events = parts(spark, sf_dir, path)
    last = events.agg(F.max("ts")).first()[0] + datetime.timedelta(days=30)
    flush = events.limit(1).withColumn("ts", F.lit(last).cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(-1).cast("bigint"))
    flush.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.event_stream(spark, path, events.schema, 100)
    got = jobs.run_all(jobs.closed_sessions(stream, late="60 days"), "closed", "append")
    want = sessions.sessions(events)
    assert got.count() == 0  # nothing is old enough under so long a watermark
    got = jobs.run_all(jobs.closed_sessions(stream), "closed2", "append").where("user_id >= 0")
    assert sorted(map(tuple, got.select("user_id", "events").collect())) == sorted(map(tuple, want.select("user_id", "events").collect()))


def test_counters_novelty_and_duplicates(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    events = parts(spark, sf_dir, path)
    stream = jobs.event_stream(spark, path, events.schema, 1)
    counters = jobs.run_all(jobs.running_counters(stream), "counters", "update").groupBy("user_id").agg(F.max("events").alias("n"), F.max("clicks").alias("c"))
    want = sessions.session_counters(events)
    assert sorted(map(tuple, counters.collect())) == sorted((r.user_id, r.events, r.n_click) for r in want.collect())
    pointers = stream.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("pointer"))
    one = jobs.event_stream(spark, path, events.schema, 100).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("pointer"))
    got = jobs.run_all(jobs.novelty_gate(one, 3), "novel", "append")
    batch = sessions.novel(events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("pointer")), "session", "pointer", "seq", 3)
    assert {r.seq for r in got.collect()} == {r.seq for r in batch.collect()}
    assert pointers.isStreaming
    once = jobs.run_all(jobs.once_per_key(stream, ["user_id", "event_type"], "3650 days"), "once", "append")
    assert once.count() == events.select("user_id", "event_type").distinct().count()


def test_latest_version_and_windows(spark, sf_dir, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "latest")
    events = parts(spark, sf_dir, path)
    stream = jobs.event_stream(spark, path, events.schema, 1)
    q = jobs.latest_per_key(stream, out, "user_id", "event_id").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = sorted((tmp_path / "latest").iterdir(), key=lambda p: int(p.name[2:]))[-1]
    got = spark.read.parquet(str(newest))
    want = events.groupBy("user_id").agg(F.max("event_id").alias("e"))
    assert {(r.user_id, r.event_id) for r in got.collect()} == {(r.user_id, r.e) for r in want.collect()}
    counts = jobs.run_all(jobs.windowed_counts(stream, "1 day", late="3650 days"), "windows", "complete")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    shutil.rmtree(out)


def test_queue_is_drained_once_and_again_after_a_failure(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from quarrygraph.sources import files

    queue, state, taken = str(tmp_path / "queue"), str(tmp_path / "state"), []
    event = lambda *names: spark.createDataFrame([(n,) for n in names], "event string")
    take = lambda batch, number: taken.extend(r[0] for r in batch.select("event").collect())

    def fail(batch, number):
        raise RuntimeError("no network")

    files.enqueue(event("a", "b"), queue)
    with pytest.raises(StreamingQueryException):
        jobs.drain_queue(spark, queue, state, fail)
    jobs.drain_queue(spark, queue, state, take)
    assert sorted(taken) == ["a", "b"]
    files.enqueue(event("c"), queue)
    (tmp_path / "queue" / "broken.json").write_text("{torn\n")
    jobs.drain_queue(spark, queue, state, take)
    jobs.drain_queue(spark, queue, state, take)
    assert sorted(taken) == ["a", "b", "c"]
