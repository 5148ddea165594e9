"""Sparse matrix times vector over a graph in parts: a part holds the edges of its nodes as packed arrays, and a round sends
to each other part one number for each node there that it reaches, in an order both know, so numbers travel without ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Nodes of a part, on average.
PART_NODES = 1 << 19
#: Nodes for one part of the joins that find the numbers of the edges' ends: about a million edges, so a task needn't spill.
JOIN_NODES = 1 << 17
#: Edges packed at a time.
PACK_EDGES = 1 << 20
PACKED = "p bigint, arrays binary"
BLOCK = "p bigint, q bigint, arrays binary"
MESSAGE = "to bigint, src bigint, y binary"


def _planes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones, and so on: the high ones are alike and compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(planes: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: whole numbers by what they exceed the least by, sorted ones by their steps."""
    head, body = [], []
    for name, x in arrays.items():
        kind, rising, low = x.dtype.str, False, 0
        if x.dtype.kind == "i" and len(x):
            rising = bool((x[1:] >= x[:-1]).all())
            low = int(x[0] if rising else x.min())
            x = np.diff(x, prepend=x[:1]) if rising else x - low
            x = x.astype(np.min_scalar_type(int(x.max())))
        planes = _planes(x)
        body.append(pa.compress(planes, "zstd", asbytes=True))
        head.append((name, kind, x.dtype.str, rising, low, len(planes), len(body[-1])))
    text = json.dumps(head).encode()
    return b"".join([len(text).to_bytes(4, "little"), text, *body])


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    at = 4 + int.from_bytes(blob[:4], "little")
    out = {}
    for name, kind, kept, rising, low, size, length in json.loads(blob[4:at]):
        x = _from_planes(pa.decompress(blob[at : at + length], size, "zstd", asbytes=True), np.dtype(kept)) if size else np.zeros(0, kept)
        if np.dtype(kind).kind == "i":
            x = (np.cumsum(x, dtype=np.int64) if rising else x.astype(np.int64)) + low
        out[name] = x.astype(kind, copy=False)
        at += length
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The values of ``keys``, equal ones of which stand in a row, and where."""
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    for lo, hi in zip(at, [*at[1:], len(keys)], strict=True):
        yield int(keys[lo]), slice(lo, hi)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b, n, pa, pb)`` as arrays for each part ``pa``, in which ``a`` stands by its position."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, n, here, there = (_column(pa.Table.from_batches(held), c) for c in ("a", "b", "n", "pa", "pb"))
        order = np.argsort(a, kind="stable")  # and so by part
        a, b, n, here, there = a[order], b[order], n[order], here[order], there[order]
        rows = [(p, _pack(a=a[k], b=b[k], n=n[k], q=there[k])) for p, k in _runs(here)]
        return pa.record_batch([pa.array([p for p, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["p", "arrays"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACK_EDGES:
            yield flush(held)
            held, size = [], 0
    if size:
        yield flush(held)


def _join(blobs: pa.ChunkedArray, names: tuple[str, ...]) -> list[np.ndarray]:
    found = [_unpack(v.as_py()) for v in blobs]
    return [np.concatenate([f[c] for f in found]) for c in names]


def deal(packed: pa.Table, places: pa.Table) -> pa.Table:
    """Edges of the nodes that stand in a part by their position, packed for the parts that hold their ends: ``a`` in the
    part that ``places(p, num, place)`` names, if any. An edge inside a part goes there once, all others both ways."""
    rows = []
    if packed.num_rows:
        here = packed.column("p")[0].as_py()
        a, b, n, q = _join(packed.column("arrays"), ("a", "b", "n", "q"))
        p = np.full(len(a), here, np.int64)
        if places.num_rows:
            num, place = _column(places, "num"), _column(places, "place")
            order = np.argsort(num)
            num, place = num[order], place[order]
            at = np.minimum(np.searchsorted(num, a), len(num) - 1)
            p = np.where(num[at] == a, place[at], p)
        out = p != q
        p, q, a, b, n = (np.concatenate([x, y[out]]) for x, y in ((p, q), (q, p), (a, b), (b, a), (n, n)))
        order = np.lexsort((a, p))
        p, q, a, b, n = (x[order] for x in (p, q, a, b, n))
        rows = [(to, _pack(a=a[k], b=b[k], n=n[k], q=q[k])) for to, k in _runs(p)]
    return pa.table({"p": pa.array([p for p, _ in rows], pa.int64()), "arrays": pa.array([v for _, v in rows], pa.binary())})


def gather(packed: pa.Table, starts: pa.Table) -> pa.Table:
    """:func:`build` of a part's packed edges."""
    if not packed.num_rows:
        return build(packed, starts)
    a, b, n, q = _join(packed.column("arrays"), ("a", "b", "n", "q"))
    return build(pa.table({"p": pa.repeat(packed.column("p")[0], len(a)), "a": a, "q": q, "b": b, "n": n}), starts)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def build(edges: pa.Table, starts: pa.Table) -> pa.Table:
    """A part's blocks of its ``edges(p, a, q, b, n)``, ``a`` its own and ``b`` of part ``q``, an edge inside the part once;
    ``starts(p, num, r, q)`` are its seeds. Row ``q = -1`` holds the part's nodes."""
    if not edges.num_rows:
        return pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "arrays": pa.array([], pa.binary())})
    p = edges.column("p")[0].as_py()
    a, b, q, n = (_column(edges, c) for c in ("a", "b", "q", "n"))
    ids = np.unique(np.concatenate([a, b[q == p]]))
    i = np.searchsorted(ids, a)
    degree = np.bincount(i, weights=n, minlength=len(ids))
    order = np.lexsort((b, a, q))  # sorted ends pack well
    at = np.flatnonzero(np.diff(q[order], prepend=-1))
    rows = []
    for lo, hi in zip(at, [*at[1:], len(order)], strict=True):
        some = order[lo:hi]
        other = int(q[some[0]])
        if other == p:
            j = np.searchsorted(ids, b[some])
            degree += np.bincount(j, weights=n[some], minlength=len(ids))
            rows.append((other, _pack(i=i[some], j=j, n=n[some])))
        else:
            far, j = np.unique(b[some], return_inverse=True)
            rows.append((other, _pack(i=i[some], j=j, n=n[some], own=np.unique(i[some]), far=np.array([len(far)]))))
    seed = np.searchsorted(ids, _column(starts, "num")) if starts.num_rows else np.zeros(0, np.int64)
    r, back = (_column(starts, c) if starts.num_rows else np.zeros(0) for c in ("r", "q"))
    rows.append((-1, _pack(ids=ids, degree=degree, seed=seed, r=r, back=back)))
    return pa.table({"p": pa.array([p] * len(rows), pa.int64()), "q": pa.array([k for k, _ in rows], pa.int64()), "arrays": pa.array([v for _, v in rows], pa.binary())})


def step(k: int, last: bool, alpha: float, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Ranks of a part after ``k`` rounds from the messages to it, and its messages of the next round; after the last
    round ``(num, rank)`` instead. A message counts in units of three digits more than ranks have, 8 bytes a number of
    which the high ones are mostly alike, and is one more than the number; 0 stands for a node that no walk has reached."""
    scale = 10.0 ** (digits + 3)

    def run(blocks: pa.Table, messages: pa.Table) -> pa.Table:
        held = {q.as_py(): _unpack(v.as_py()) for q, v in zip(blocks.column("q"), blocks.column("arrays"), strict=True)}
        own = held.pop(-1)
        p = blocks.column("p")[0].as_py()
        seed, r, q, degree = (own[c] for c in ("seed", "r", "back", "degree"))
        size = len(degree)
        rank, reached = np.zeros(size), np.zeros(size, bool)
        reached[seed] = True
        if k == 0:
            rank[seed] = r
        else:
            stay = q ** (k - 1)
            rank[seed] = r * (alpha + q * (stay + alpha * (1 - stay) / (1 - q)))
            got = sorted(zip(messages.column("src").to_pylist(), messages.column("y"), strict=True), key=lambda m: m[0])
            for src, blob in got:
                y = _from_planes(blob.as_py(), np.dtype(np.int64))
                known = y > 0
                at = np.flatnonzero(known) if src == p else held[src]["own"][known]
                rank[at] += (y[known] - 1) / scale
                reached[at] = True
            rank = np.round(rank, digits)
        if last:
            return pa.table({"num": own["ids"][reached], "rank": rank[reached]})
        share, live, out = (1 - alpha) * rank / degree, reached.astype(np.float64), []
        for other, block in held.items() if reached.any() else ():
            i, j, n = block["i"], block["j"], block["n"]
            far = size if other == p else int(block["far"][0])
            y = np.bincount(j, weights=share[i] * n, minlength=far)
            met = None if reached.all() else np.bincount(j, weights=live[i], minlength=far)
            if other == p:
                y += np.bincount(i, weights=share[j] * n, minlength=far)
                met = None if met is None else met + np.bincount(i, weights=live[j], minlength=far)
                met = np.bincount(np.concatenate([i, j]), minlength=far) if met is None else met
            y = np.rint(y * scale).astype(np.int64) + 1
            if met is not None:
                y[met == 0] = 0
            if y.any():
                out.append((other, _planes(y)))
        return pa.table({"to": pa.array([o for o, _ in out], pa.int64()), "src": pa.array([p] * len(out), pa.int64()), "y": pa.array([y for _, y in out], pa.binary())})

    return run
