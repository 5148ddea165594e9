"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles with exclusive-or and bit counts.

Distinct fingerprints are grouped by the population counts of their four quarters. Two fingerprints at Hamming
distance r differ by at most r in the sum of the four counts' differences, so a tile meets only the tiles of the
classes within that distance: the join on class keys skips all other tile pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, write_shared

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a tile, and tiles of a class that meet other tiles under one key of the join.
TILE, GROUP = 1024, 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    many = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * many > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``(doc_id, fp BIGINT, *more)`` of every whole text, the fingerprint's 64 bits as a signed number; null texts are
    empty and have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:]]
    return source.mapInArrow(run, ", ".join(["doc_id bigint", "fp bigint", *kinds]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that isn't its component's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near(left: np.ndarray, right: np.ndarray, radius: int, strip: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs at Hamming distance ``radius`` or less."""
    xs, ys = [], []
    for k in range(0, len(left), strip):
        x, y = np.nonzero(np.bitwise_count(left[k : k + strip, None] ^ right[None, :]) <= radius)
        xs.append(x + k)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _offsets(radius: int) -> list[int]:
    """Class-key differences within the radius, each pair of opposite ones once; a key has five bits for a quarter."""
    out = []
    for d in product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.append(((d[0] * 32 + d[1]) * 32 + d[2]) * 32 + d[3])
    return out


def near_links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Forest edges ``(a, b)`` that connect exactly the ids of ``points(fp, id)`` (distinct fp) whose fingerprints lie
    within ``radius``. A class of any size is dealt into tiles by hash, so no tile grows with the data; of a class,
    ``GROUP`` tiles share a key of the join, and the other side's rows of a key are what AQE can split."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    # five bits hold 0..16; the margins between used values keep differences unambiguous
    keyed = points.withColumn("key", ((quarter[3] * 32 + quarter[2]) * 32 + quarter[1]) * 32 + quarter[0])
    counts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("tiles"))  # at most 17**4 rows
    dealt = keyed.join(F.broadcast(counts), "key").withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("tiles")))
    tiles = write_shared(dealt.groupBy("key", "salt").agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids")), "simhash-tiles")
    tiles = tiles.withColumn("part", F.floor(F.col("salt") / GROUP))
    left = tiles.select(F.col("salt").alias("left_salt"), F.col("key").alias("left_key"), F.col("fps").alias("left_fps"), F.col("ids").alias("left_ids"), F.explode(F.array(*[F.lit(x) for x in _offsets(radius)])).alias("step"))
    left = left.withColumn("key", F.col("left_key") + F.col("step")).join(F.broadcast(counts), "key").drop("step")
    least = F.when(F.col("left_key") == F.col("key"), F.floor(F.col("left_salt") / GROUP)).otherwise(F.lit(0))
    left = left.withColumn("part", F.explode(F.sequence(least, F.floor((F.col("tiles") - 1) / GROUP)))).drop("tiles")
    pairs = left.join(tiles, ["key", "part"]).where("left_key <> key or left_salt <= salt")
    pairs = pairs.select((F.expr("left_key = key and left_salt = salt")).alias("own"), "left_fps", "left_ids", "fps", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                f, i, g, j = (batch.column(c)[k].values.to_numpy() for c in range(1, 5))
                x, y = near(f.view(np.uint64), g.view(np.uint64), radius)
                if own[k]:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    links.append(forest(i[x], j[y]))
                    held += len(links[-1][0])
                if held > 2_000_000:
                    links = [forest(*map(np.concatenate, zip(*links, strict=True)))]
                    held = len(links[0][0])
        if links:
            a, b = forest(*map(np.concatenate, zip(*links, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    return write_shared(fingerprints(docs, shingle), "simhash")


def _named(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """``(fp, component)`` of the distinct fingerprints that some document with a doc_id has. What is linked are
    fingerprints, not doc_ids, so unrelated texts of one doc_id stay apart."""
    known = prints.where("doc_id is not null").select("fp").distinct().withColumn("id", F.col("fp"))
    links = connected_components(near_links(known, radius, tile), "simhash-cc")
    return known.join(links, known.id == links.node, "left").select("fp", F.coalesce("component", "id").alias("component"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row a document; ``component_id`` is the smallest doc_id reachable
    over links of at most ``radius`` differing bits, itself included.

    Equal fingerprints are one point from the start, so copies cost nothing and are never expanded into pairs. A null
    text is empty (fingerprint zero, linked like any other); a null doc_id keeps its fingerprint and belongs to the
    smallest known doc_id of its component; repeated rows are returned each, and different texts of one doc_id belong
    each to the component of its own fingerprint; an empty table gives no rows.
    """
    prints = _prints(docs, shingle)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    sets = write_shared(_named(prints, radius, tile).join(least, "fp"), "simhash-sets")
    named = sets.join(sets.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its own columns, whatever their names, of each component one row: of those with the component's
    smallest doc_id the first by text hash, then by its other columns as JSON. So where rows of one doc_id have
    unrelated texts, each of their components keeps a row. Rows without a doc_id can't be named as copies of each other
    and stay. A null text is as an empty one; an empty table gives no rows."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.where("doc_id is not null").select(row, F.col("doc_id").cast("bigint").alias("id"), digest, F.coalesce(rest, F.lit("")).alias("rest"))
    prints = write_shared(fingerprints(docs.select("doc_id", "text"), shingle, digest), "simhash")
    mine = prints.where("doc_id is not null").join(_named(prints, radius, TILE), "fp")
    stay = mine.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("one")).select(F.col("one.doc_id").alias("id"), F.col("one.digest").alias("digest"))
    kept = rows.join(stay, ["id", "digest"]).groupBy("id", "digest").agg(F.min_by("row", "rest").alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
