"""Embedding near-duplicates by spherical-cap filters of structured random product codes.

A filter direction is a pair of code words, one for each half of a vector's components. A vector passes all filters
whose inner product with it exceeds a threshold; because the product splits into two sums, these are listed from the
two sorted lists of partial products without looking at the others. Vectors that share a label and a filter meet in a
bucket, where all pairs are compared in double precision. A pair is counted only in the bucket of the smallest filter
that both passed, so no pairs have to be gathered to remove repeats.

The codes' size follows the number of vectors (buckets stay small), and the threshold is set from the exact tail of the
sphere so that two vectors at the linking cosine have ``EXPECTED`` filters of each code in common on average, however
large the codes are. There are ``CODES`` codes, each in
another rotation, because the filters of one code are passed or missed together. Measured on pairs at exactly the
linking cosine, fewer than one in a hundred have no filter in common; the tests hold that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, write_shared
from .simhash import forest

#: Production parameters: linking cosine, common filters of a code expected at that cosine, codes, rows of a tile.
COSINE, EXPECTED, CODES, TILE = 0.93, 10.0, 4, 2048
#: Vectors and code words are rounded to this many steps, so that sums are exact whatever their order.
STEPS = float(1 << 20)
#: The largest threshold. Short vectors get fewer code words instead of a higher one: there the two halves of a filter
#: are too short to be independent of each other.
MOST_LIMIT = 0.6
#: Buckets of up to so many points are compared together, all of one size at a time.
SMALL = 64


def both_exceed(limit: float, cosine: float, dim: int) -> float:
    """Probability that the inner products of two unit vectors at ``cosine`` with a direction that is uniform on the
    sphere of ``dim`` components (three at least) both exceed ``limit`` (0 to 1). Exact: in the vectors' plane the
    direction's projection has length over r with probability (1 - r * r) ** (dim / 2 - 1), whatever its angle."""
    half = math.acos(cosine) / 2
    angle = np.linspace(half, max(half, math.acos(limit)), 4001)
    beyond = np.maximum(0, 1 - (limit / np.maximum(np.cos(angle), 1e-300)) ** 2) ** (dim / 2 - 1)
    return float(np.sum((beyond[1:] + beyond[:-1]) / 2) * (angle[1] - angle[0])) / math.pi


@dataclass(frozen=True)
class Code:
    """``codes`` codes of ``words`` code words for each half; two vectors at ``cosine`` have ``expected`` filters of
    each in common on average."""

    words: int
    cosine: float = COSINE
    expected: float = EXPECTED
    codes: int = CODES
    seed: int = 17

    @staticmethod
    def of(vectors: int, cosine: float = COSINE, expected: float = EXPECTED) -> Code:
        return Code(max(32, 1 << round(math.log2(max(1, vectors)) / 2)), cosine, expected)


@lru_cache(maxsize=64)
def fitted(code: Code, dim: int) -> Code:
    """The code for vectors of ``dim`` components: half as many words, until the threshold is ``MOST_LIMIT`` at most."""
    while code.words > 8 and threshold(code, dim) > MOST_LIMIT:
        code = replace(code, words=code.words // 2)
    return code


@lru_cache(maxsize=64)
def threshold(code: Code, dim: int) -> float:
    """The inner product that a vector of ``dim`` components must exceed to pass a filter; 1, where none gives enough
    common filters. A filter of a random rotation is uniform on the sphere for any one pair of vectors."""
    share = code.expected / code.words**2
    if dim < 3 or both_exceed(0.0, code.cosine, dim) <= share:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if both_exceed(mid, code.cosine, dim) > share else (lo, mid)
    return lo


@lru_cache(maxsize=16)
def _words(code: Code, dim: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The two matrices that give a vector's inner products with both halves' code words, in rounded steps."""
    rng = np.random.default_rng([code.seed, dim, code.words, number])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    halves = []
    for part in (turn[: (dim + 1) // 2], turn[(dim + 1) // 2 :]):
        w = rng.standard_normal((code.words, len(part)))
        # each half of a filter has the length that it has in a unit vector of random direction on average
        w *= math.sqrt(len(part) / dim) / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        halves.append(np.rint((w @ part).T * STEPS))
    return halves[0], halves[1]


def filters(unit: np.ndarray, code: Code) -> list[np.ndarray]:
    """The numbers, in order, of all filters that each unit vector passes. Vectors of one or two components all pass
    one: there an eighth of all pairs links."""
    dim = unit.shape[1]
    if dim < 3:
        return [np.zeros(1, np.int64) for _ in unit]
    code = fitted(code, dim)
    limit = threshold(code, dim) * STEPS * STEPS
    x = np.rint(unit * STEPS)
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for number in range(code.codes):
        a, b = _words(code, dim, number)
        for found, left, right in zip(out, x @ a, x @ b, strict=True):
            order = np.argsort(right, kind="stable")
            need = len(right) - np.searchsorted(right[order], limit - left)  # how many of the largest partners suffice
            at = np.flatnonzero(need)
            many = need[at]
            ends = np.cumsum(many)
            partner = order[len(right) - 1 - (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many))]
            found.append((number * code.words + np.repeat(at, many)) * code.words + partner)
    return [np.sort(np.concatenate(f)) for f in out]


def _vectors(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return [x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in column]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _expand(code: Code, with_vector: bool):
    """A row for each vector and filter that it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch, "embedding")
            by_dim: dict[int, list[int]] = {}
            for k, r in enumerate(rows):
                by_dim.setdefault(len(r), []).append(k)
            for dim, places in by_dim.items():
                for part in (places[k : k + 512] for k in range(0, len(places), 512)):
                    found = filters(_units(np.stack([rows[k] for k in part])), code)
                    many = np.array([len(f) for f in found])
                    take = pa.array(np.repeat(part, many))
                    number = pa.array(np.concatenate(found) + dim * code.codes * code.words * code.words)
                    out = {"label": batch.column(0).take(take), "filter": number}
                    if with_vector:
                        out |= {"id": batch.column(1).take(take), "many": batch.column(2).take(take), "embedding": batch.column(3).take(take)}
                    for k in range(0, len(number), 8192):
                        yield pa.RecordBatch.from_pydict({n: c.slice(k, 8192) for n, c in out.items()})

    return run


def _shared_lower(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs have a filter in common."""
    either = np.unique(np.concatenate([*left, np.empty(0, np.int64)]))
    either = either[np.isin(either, np.concatenate([*right, np.empty(0, np.int64)]))]
    out = np.zeros((len(left), len(right)), bool)
    for k in range(0, len(either), 2048):
        some = either[k : k + 2048]
        x, y = (np.zeros((len(side), len(some)), np.float32) for side in (left, right))
        for m, side in ((x, left), (y, right)):
            for i, f in enumerate(side):
                m[i, np.searchsorted(some, f[np.isin(f, some)])] = 1
        out |= x @ y.T > 0
    return out


def _pairs_of_small(x: np.ndarray, norm: np.ndarray, first: np.ndarray, size: np.ndarray, side: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of the small groups of rows that begin at ``first`` and have ``size`` rows each."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in np.unique(size):
        at = first[size == s][:, None] + np.arange(s)
        y, length, half = x[at], norm[at], side[at]
        hit = y @ y.transpose(0, 2, 1) / (length[:, :, None] * length[:, None, :]) >= cosine
        hit &= np.triu(np.ones((s, s), bool), 1) & (own[at[:, 0]][:, None, None] | (half[:, :, None] != half[:, None, :]))
        g, i, j = np.nonzero(hit)
        left.append(at[g, i])
        right.append(at[g, j])
    return np.concatenate(left), np.concatenate(right)


def _compare(cosine: float, code: Code):
    """Rows come in order of label, filter and pair of tiles: all pairs of such a group that link and meet first in
    this bucket, as each member's number of linked vectors, and edges that connect what is linked."""
    numbers = code.codes * code.words * code.words

    def large(x: np.ndarray, norm: np.ndarray, side: np.ndarray, own: bool, number: int, many: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        p = np.arange(len(x)) if own else np.flatnonzero(side == 0)
        q = p if own else np.flatnonzero(side == 1)
        for k in range(0, len(p), 256):
            a = p[k : k + 256]
            hit = x[a] @ x[q].T / (norm[a][:, None] * norm[q][None, :]) >= cosine
            if own:
                hit &= a[:, None] < q[None, :]
            if not hit.any():
                continue
            i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            lower = {int(r): f[f < number] for part in (a[i], q[j]) for r, f in zip(part, filters(_units(x[part]), code), strict=True)}
            hit = hit[np.ix_(i, j)] & ~_shared_lower([lower[int(r)] for r in a[i]], [lower[int(r)] for r in q[j]])
            n[a[i]] += hit @ many[q[j]]
            n[q[j]] += hit.T @ many[a[i]]
            u, v = np.nonzero(hit)
            if len(u):
                yield a[i][u], q[j][v]

    def groups(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, many, side = (rows[c].to_numpy() for c in ("id", "many", "side"))
        own, number = rows["p"].to_numpy() == rows["q"].to_numpy(), rows["filter"].to_numpy() % numbers
        size = np.diff(np.append(starts, len(ids)))
        group = np.repeat(np.arange(len(size)), size)
        vectors = rows["embedding"].combine_chunks()
        dims = np.diff(vectors.offsets.to_numpy())
        n, edges = np.zeros(len(ids), np.int64), []
        for dim in np.unique(dims):
            here = np.flatnonzero(dims == dim)
            if (size[group[here]] < 2).all():
                continue
            here = here[size[group[here]] > 1]
            x = np.stack([vectors[int(k)].values.to_numpy(zero_copy_only=False) for k in here]) if len(dims) != len(here) else vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(here), dim)
            x = x.astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # of no effect on a cosine but that squares don't overflow
            norm = np.linalg.norm(x, axis=1)
            begin = np.flatnonzero(np.diff(group[here], prepend=-1))
            count = size[group[here[begin]]]
            small = count <= SMALL
            i, j = _pairs_of_small(x, norm, begin[small], count[small], side[here], own[here], cosine)
            if len(i):
                some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                lower = [frozenset(f[f < number[here[k]]].tolist()) for k, f in zip(some, filters(_units(x[some]), code), strict=True)]
                u, v = place[: len(i)], place[len(i) :]
                first = np.array([lower[a].isdisjoint(lower[b]) for a, b in zip(u.tolist(), v.tolist(), strict=True)])
                i, j = here[i[first]], here[j[first]]
                np.add.at(n, i, many[j])
                np.add.at(n, j, many[i])
                edges.append(forest(ids[i], ids[j]))
            for k, many_rows in zip(begin[~small], count[~small], strict=True):
                where = slice(k, k + many_rows)
                at = here[where]
                part = np.zeros(len(at), np.int64)
                edges += [forest(ids[at[i]], ids[at[j]]) for i, j in large(x[where], norm[where], side[at], bool(own[at[0]]), int(number[at[0]]), many[at], part)]
                n[at] += part
        some = np.flatnonzero(n)
        if not len(some):
            return None
        a, b = forest(*map(np.concatenate, zip(*edges, strict=True)))
        columns = [pa.concat_arrays([pa.array(ids[some]), pa.array(a)]), pa.concat_arrays([pa.array(n[some]), pa.nulls(len(a), pa.int64())]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b)])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "n", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts(held)
            if len(starts) > 1:  # the last group may go on in the next batch
                out = groups(held.slice(0, starts[-1]), starts[:-1])
                if out:
                    yield out
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            out = groups(held, _starts(held))
            if out:
                yield out

    return run


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new label, filter or pair of tiles begins."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("label", "filter", "p", "q"):
        column = rows[name].combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def near_duplicates(table: DataFrame, cosine: float = COSINE, expected: float = EXPECTED, tile: int = TILE, code: Code | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row a vector of ``table(vec_id, embedding, label)``.

    Vectors link if their labels are equal and not null and their cosine is ``cosine`` or more. Vectors that are null,
    empty, zero, or hold a null or non-finite component, vectors without a vec_id, and vectors of different numbers of
    components link with nothing. Equal vectors of a label are one point with a count; repeated rows are counted as
    vectors. A bucket of more than ``tile`` points is compared in pairs of tiles that are dealt to different tasks. An
    empty table gives no rows; other columns are ignored.
    """
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    points = write_shared(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "points")
    if code is None:
        largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        code = Code.of(largest, cosine, expected)
    source = points.select("label", "id", "many", "embedding")
    label, vector = source.schema["label"].dataType.simpleString(), source.schema["embedding"].dataType.simpleString()
    counts = source.mapInArrow(_expand(code, False), f"label {label}, filter bigint").groupBy("label", "filter").count()
    hot = write_shared(counts.where(F.col("count") > tile).select("label", "filter", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "buckets")
    passed = source.mapInArrow(_expand(code, True), f"label {label}, filter bigint, id bigint, many bigint, embedding {vector}")
    dealt = passed.join(hot, ["label", "filter"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "filter", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "many", "embedding")
    together = dealt.repartition("label", "filter", "p", "q").sortWithinPartitions("label", "filter", "p", "q", "side")
    found = together.mapInArrow(_compare(cosine, code), "a bigint, n bigint, b bigint")
    found = write_shared(found, "links")
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"), "embedding-cc")
    named = points.join(links, points.id == links.a, "left").join(parts, points.id == parts.node, "left")
    named = named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # nothing that isn't a point has an equal among the points, but for rows without a vec_id
    joined = rows.join(named, ["label", "embedding"], "left")
    alone = F.col("vec_id").isNull() | F.col("component_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, b FROM reach JOIN links ON r = a
), parts AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
