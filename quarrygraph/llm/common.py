"""Helpers shared by the training-data operators: table readers, shared-folder tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where a session names none (local
    tests) one temporary folder is made for the session and set as its checkpoint folder; on a cluster, where each
    machine would have its own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(sc, "_quarry_shared", None)
    if known is None:
        known = sc._quarry_shared = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        sc.setCheckpointDir(known)
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    sc._quarry_written = [*getattr(sc, "_quarry_written", ()), path]
    return path


def drop_shared(spark: SparkSession) -> int:
    """Removes all tables that this session wrote to the shared folder, and says how many. For when the results that
    read them have been written: until then a lost task may need them again."""
    sc = spark.sparkContext
    paths, sc._quarry_written = getattr(sc, "_quarry_written", []), []
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def write_shared(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a reader of it; lineage ends there, and a lost
    executor costs a re-read at most."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Alternating large-star and small-star contraction over ``edges(a BIGINT, b BIGINT)``.

    Returns ``(node, component)`` for every node of an edge between two different nodes; ``component`` is the
    smallest node reachable. Repeated and self edges are allowed, nulls are dropped, no edges give no rows. Minima
    are aggregated before the shuffle and joined back, so a star with very many leaves is a skewed join that AQE
    splits, never one task's group. Each round is written to the shared folder. A round that changes nothing ends the
    loop; if none of ``max_rounds`` does, that is an error.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    e = write_shared(e.distinct(), name)
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b") % 1000003).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["x"], state["s"]) == seen:
            break
        seen = (state["n"], state["x"], state["s"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = write_shared(small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), name)
    else:
        raise RuntimeError(f"components of {name} are still changing after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


#: Items folded at a time by :func:`scan`.
SCAN_BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: an expression inside a lambda is worked out for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, out: str) -> Column:
    """What ``step(state, item) -> (next state, emitted)`` emits, from first to last item, as an array of type ``out``.

    An array that a fold appends to is copied at each step, so the items are folded in blocks: once for the state that
    each block starts from, then each block for what it emits, and no fold carries more than one block's output.
    """
    nothing = F.expr(f"cast(array() as array<{out}>)")

    def over(items: Column) -> Column:
        many = F.floor((F.size(items) + (SCAN_BLOCK - 1)) / SCAN_BLOCK).cast("int")

        def places(k: Column) -> Column:
            return F.sequence(k * SCAN_BLOCK, F.least((k + 1) * SCAN_BLOCK, F.size(items)) - 1)

        def passed(at: Column, k: Column) -> Column:
            return step(at, F.get(items, k))[0].cast(state)

        def one(s: Column, k: Column) -> Column:
            at, emitted = step(s["at"], F.get(items, k))
            return F.struct(at.cast(state).alias("at"), F.concat(s["out"], F.array(emitted.cast(out))).alias("out"))

        def following(starts: Column, k: Column) -> Column:
            return F.concat(starts, F.array(F.aggregate(places(k), F.element_at(starts, -1), passed)))

        def emitted(starts: Column) -> Column:
            def block(k: Column) -> Column:
                return F.aggregate(places(k), F.struct(F.get(starts, k).alias("at"), nothing.alias("out")), one)["out"]

            return F.flatten(F.transform(F.sequence(F.lit(0), many - 1), block))

        starts = F.aggregate(F.sequence(F.lit(0), many - 1), F.array(zero.cast(state)), following)
        return F.when(many > 0, bound(starts, emitted)).otherwise(nothing)

    return bound(items, over)
