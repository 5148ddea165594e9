"""Cutting lineage in iterations: tables written to the folder that driver and executors share, and removed when spent."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: a command that has ended removes its shuffle files; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder made once for the session.
    On a cluster, where each machine would have its own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_quarry_folder"):
        sc._quarry_folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return sc._quarry_folder


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and returns a reader of it. The shuffle files that the write needed are gone then."""
    path = f"{shared_folder(df.sparkSession)}/cut/{name}-{uuid.uuid4().hex[:12]}"
    with _cleaning(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables that :func:`cut` returned. Nothing that is still to be computed may read them, nor may a part that is
    lost later need them."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder.rsplit("/", 2)[-2] != "cut":
                raise ValueError(f"{folder} is not a table of this session's own")
            place = sc._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
