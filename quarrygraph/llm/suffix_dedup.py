"""Removal of byte strings that also start in an earlier document: sparse, distributed prefix doubling.

A position's rank at length h names the h bytes that start there. Ranks at 25 bytes are polynomial names that any task
computes alone; the rank at 50 is the pair of the ranks at offsets 0 and 25. Spark deals the ranks of all blocks to
buckets by their leading bits, each bucket is sorted, and every entry learns whether it is unique; what is unique drops
out, the rest goes on to the next, longer round:

1. length 25, one rank for each run of windows that share their least 25-byte rank. Equal 50-byte strings share that
   least rank, so a string whose rank is unique to a document is in no other one.
2. whole runs. Runs of equal bytes are settled together: all but the first document's are covered. Only the first
   of each kind goes on, and only where its rank has runs of different bytes.
3. length 50, the rank pairs of each position in these runs.

What is dealt is mixed first (least ranks crowd near zero), and in round 2 the runs of one rank are dealt by their
bytes, so buckets are even. An entry is sent once a block with its smallest doc_id, so a string that is in a third of
all documents is one entry a block. A reply is a bit an entry. Texts are written once, as blocks in a table bucketed by
block; every round reads them in place and no round moves them. The numbers of buckets follow the bytes of text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, write_shared

#: Production parameters: length of a removed string, bytes of text in a block, for a bucket of ranks, for a bucket of
#: the table of blocks.
LENGTH, BLOCK_BYTES, BUCKET_BYTES, TABLE_BYTES = 50, 4 << 20, 50 << 20, 128 << 20
#: Bytes of text whose names are worked out at a time; what a task holds besides the text itself is bounded by it.
PIECE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 5
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_LOW48 = np.uint64((1 << 48) - 1)
_held: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(n + n // 4, base, np.uint64)
            step[0] = 1
            _held[name] = np.cumprod(step, dtype=np.uint64)
    return _held["up"][:n], _held["down"][:n]


class Block:
    """Whole texts laid end to end, and the runs of windows that share their least rank.

    Work goes by pieces: some whole texts, or a part of a long one. A run ends with its piece, which costs at most
    that equal runs cut at different places are compared window by window in the third round.
    """

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, text: bytes, length: int):
        self.length, self.half = length, (length + 1) // 2
        self.bytes = np.frombuffer(text, np.uint8)
        self.doc_ids, self.ends = doc_ids, np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        runs = [self._runs(*piece) for piece in self._cut()]
        self.pieces = np.array([r[0] for r in runs], np.int64).reshape(-1, 2)
        self.value = np.concatenate([np.empty(0, np.uint64), *(r[1] for r in runs)])
        self.lo, self.size, self.doc = (np.concatenate([np.empty(0, np.int64), *(r[k] for r in runs)]) for k in (2, 3, 4))

    def _cut(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces as first and last document, first and last start of a window, and end of the bytes."""
        first = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + PIECE_BYTES, "right")))
            a, end = int(self.starts[first]), int(self.ends[last - 1])
            step = PIECE_BYTES if last == first + 1 else end - a
            for at in range(a, end, max(1, step)):
                until = min(at + step, end)
                stop = min(until + self.length - 1, end)
                if stop - at >= self.length:
                    yield first, last, at, min(until, stop - self.length + 1), stop
            first = last

    def _prefix(self, a: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        n = stop - a
        up, down = _powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.bytes[a:stop]] * up[:n], out=out[1:])
        return out, down

    def names(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Unmixed names of the ``size`` bytes at the positions, which are in order and within pieces."""
        out = np.empty(len(at), np.uint64)
        cut = np.append(np.searchsorted(at, self.pieces[:, 0]), len(at))
        for (a, stop), lo, hi in zip(self.pieces, cut[:-1], cut[1:], strict=True):
            if lo < hi:
                prefix, down = self._prefix(int(a), int(stop))
                x = at[lo:hi] - a
                out[lo:hi] = (prefix[x + (size if isinstance(size, int) else size[lo:hi])] - prefix[x]) * down[x]
        return out

    def _runs(self, first: int, last: int, a: int, until: int, stop: int) -> tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        windows = until - a
        prefix, down = self._prefix(a, stop)
        n = len(prefix) - self.half
        rank = _mix((prefix[self.half :] - prefix[:n]) * down[:n])
        width, span = self.length - self.half + 1, 1
        least = rank
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:windows], least[width - span : width - span + windows])
        if last == first + 1:
            owner, inside = np.full(windows, first), np.ones(windows, bool)
        else:
            owner = np.repeat(np.arange(first, last), self.ends[first:last] - self.starts[first:last])
            inside = owner[:windows] == owner[self.length - 1 : self.length - 1 + windows]
        change = np.ones(windows + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (owner[1:windows] != owner[: windows - 1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(change)
        lo, size = at[:-1], np.diff(at)
        good = inside[lo]
        lo, size = lo[good], size[good]
        return (a, stop), _mix(least[lo]), lo + a, size, owner[lo]  # a least rank is mixed anew: it would crowd near zero

    # round 1: entries are the distinct values

    def first_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values in order, each run's place in them, and whether a value is in two documents of the block."""
        distinct, place = np.unique(self.value, return_inverse=True)
        low, high = np.full(len(distinct), len(self.doc_ids)), np.full(len(distinct), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return distinct, place, low != high

    # round 2: entries are the distinct runs, with the smallest doc_id; and the distinct values, with least and
    # greatest name of their runs

    def second_entries(self, runs: np.ndarray) -> tuple[tuple, tuple]:
        """``(majors, names, smallest doc_ids, each run's place)`` of the distinct runs and ``(values, least names,
        greatest names, each run's place)`` of the values, in order."""
        size = self.size[runs] + self.length - 1
        name = _mix(self.names(self.lo[runs], size) * _C + size.astype(np.uint64))
        values, place = np.unique(self.value[runs], return_inverse=True)
        least, most = np.full(len(values), np.uint64((1 << 64) - 1)), np.zeros(len(values), np.uint64)
        np.minimum.at(least, place, name & _LOW48)  # as many bits as are sent
        np.maximum.at(most, place, name & _LOW48)
        return _distinct(_mix(self.value[runs] + name * _C), name, self.doc_ids[self.doc[runs]]), (values, least, most, place)

    # round 3: entries are the distinct rank pairs, with the smallest doc_id

    def third_entries(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As the distinct runs in round 2 for each window of the runs, and the windows' positions and documents."""
        size = self.size[runs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.lo[runs], size)
        doc = np.repeat(self.doc[runs], size)
        left, right = self.names(at, self.half), self.names(at, self.length) - self.names(at, self.half)
        return *_distinct(_mix(left * _C + _mix(right)), _mix(right * _B + _mix(left)), self.doc_ids[doc]), at, doc


def _distinct(major: np.ndarray, minor: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc_ids, minor, major))
    a, b = major[order], minor[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], doc_ids[order][new], place


def _buckets(major: np.ndarray, n: int) -> np.ndarray:
    """Entries are in order of their major name, so buckets are slices: the place where each begins."""
    return np.searchsorted(((major >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), np.arange(n + 1))


def _low48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _ids(doc_ids: np.ndarray) -> tuple[int, bytes]:
    """Smallest doc_id and the differences to it, in as few bytes as the largest needs."""
    if not len(doc_ids):
        return 0, b""
    base = int(doc_ids.min())
    gap = doc_ids.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    width = next(w for w in (2, 4, 8) if int(gap.max()) < 1 << 8 * w)
    return base, gap.astype(f"<u{width}").tobytes()


def _from_ids(base: int, blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    return (np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.uint64) + np.uint64(base & (1 << 64) - 1)).astype(np.int64)


def _bits(parts: list[bytes], counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.empty(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=int(c)) for p, c in zip(parts, counts, strict=True)]).astype(bool)


_ENTRY = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("major", pa.binary()), ("minor", pa.binary()), ("base", pa.int64()), ("ids", pa.binary())])
_REPLY = "block bigint, bucket bigint, bits binary"
_SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Rounds:
    """The work of one round over blocks; ``know`` is the number of rounds whose replies are known. In round 2 the
    buckets of the values come after those of the runs."""

    def __init__(self, length: int, buckets: int, know: int):
        self.length, self.buckets, self.know = length, buckets, know

    def replies(self, row: dict, k: int, major: np.ndarray, first: int = 0) -> np.ndarray:
        """The bit of every entry of round ``k``, from the replies by bucket."""
        counts = np.diff(_buckets(major, self.buckets))
        by = {r["bucket"]: r["bits"] for r in row[f"r{k}"] or ()}
        full = np.flatnonzero(counts)
        return _bits([by[int(x) + first] for x in full], counts[full])

    def block(self, row: dict) -> tuple:
        """The block, and the entries of the next round or, after the last, the covered runs and windows."""
        b = Block(np.array(row["doc_ids"], np.int64), np.array(row["sizes"], np.int64), row["text"], self.length)
        values, place, local = b.first_entries()
        if self.know == 0:
            return b, [(0, values, None, None)]
        shared = self.replies(row, 1, values) | local
        runs = np.flatnonzero(shared[place])
        (major, name, smallest, place), (values, least, most, rank) = b.second_entries(runs)
        if self.know == 1:
            return b, [(0, major, name, smallest), (self.buckets, values, least, most)]
        covered = self.replies(row, 2, major)[place] | (b.doc_ids[b.doc[runs]] > smallest[place])
        several = self.replies(row, 2, values, self.buckets)[rank]
        major, name, smallest, place, at, doc = b.third_entries(runs[several & ~covered])
        if self.know == 2:
            return b, [(0, major, name, smallest)]
        hit = self.replies(row, 3, major)[place] | (b.doc_ids[doc] > smallest[place])
        return b, (runs[covered], at[hit], doc[hit])

    def entries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = []
            for first, major, minor, last in self.block(row)[1]:
                cut = _buckets(major, self.buckets)
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    if first:
                        same = (minor[s] == last[s]).all()
                        more = _low48(minor[s]), 0, b"" if same else _low48(last[s])
                    else:
                        more = (b"", 0, b"") if minor is None else (minor[s].astype("<u8").tobytes(), *_ids(last[s]))
                    out.append((int(k) + first, row["block"], _low48(major[s]), *more))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    def spans(self, row: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        """The block, and document, start and end of its maximal removed runs, in order."""
        b, (runs, at, doc) = self.block(row)
        lo = np.concatenate([b.lo[runs], at])
        order = np.argsort(lo, kind="stable")
        lo = lo[order]
        hi = np.concatenate([b.lo[runs] + b.size[runs] + self.length - 1, at + self.length])[order]
        doc = np.concatenate([b.doc[runs], doc])[order]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        return b, doc[begin], lo[begin], np.maximum.reduceat(hi, begin) if len(begin) else hi

    def result(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, doc, start, end = self.spans(row)
            n = len(b.doc_ids)
            removed = np.bincount(doc, end - start, n).astype(np.int64)
            first = np.searchsorted(doc, np.arange(n + 1))
            digests = [hashlib.sha256(b"".join(x)).hexdigest() for x in _kept(b, first, start, end)]
            places = [pa.array(x - b.starts[doc]) for x in (start, end)]
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(places, fields=list(_SPANS)))
            ids = pa.array(b.doc_ids, mask=np.array(row["missing"], bool))
            columns = [ids, pa.array(b.ends - b.starts), pa.array(removed), pa.array(np.diff(first)), pa.array(digests, pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, doc, start, end = self.spans(row)
            ids = pa.array(b.doc_ids, mask=np.array(row["missing"], bool))
            kept = _kept(b, np.searchsorted(doc, np.arange(len(b.doc_ids) + 1)), start, end)
            yield pa.RecordBatch.from_arrays([ids, pa.array([b"".join(x).decode("utf-8", "replace") for x in kept], pa.string())], names=["doc_id", "text"])


def _kept(b: Block, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[list[memoryview]]:
    """What is left of each text, in pieces."""
    for k, (lo, hi) in enumerate(zip(b.starts.tolist(), b.ends.tolist(), strict=True)):
        mine = slice(first[k], first[k + 1])
        yield [b.bytes[x:y].data for x, y in zip([lo, *end[mine].tolist()], [*start[mine].tolist(), hi], strict=True) if x < y]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _sort_bucket(number: int, buckets: int):
    """Sorts the entries of a bucket and answers each by a bit: of a rank in round 1, whether another block has it; of
    a run or a window, whether an earlier document has it; of a value in round 2, whether it has several runs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        majors = [_from48(x.as_py()) for x in table["major"]]
        counts = np.array([len(m) for m in majors])
        major = np.concatenate(majors)
        bits = np.zeros(len(major), bool)
        if number == 1:
            order = np.argsort(major, kind="stable")
            same = major[order[1:]] == major[order[:-1]]
            bits[order[1:]] |= same
            bits[order[:-1]] |= same
        elif key[0].as_py() < buckets:
            minor = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table["minor"]])
            ids = np.concatenate([_from_ids(b.as_py(), x.as_py(), int(c)) for b, x, c in zip(table["base"], table["ids"], counts, strict=True)])
            order = np.lexsort((ids, minor, major))
            a, b, d = major[order], minor[order], ids[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            bits[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        else:
            _, place = np.unique(major, return_inverse=True)
            low, high = np.full(len(major), np.uint64((1 << 64) - 1)), np.zeros(len(major), np.uint64)
            np.minimum.at(low, place, np.concatenate([_from48(x.as_py()) for x in table["minor"]]))
            np.maximum.at(high, place, np.concatenate([_from48(x.as_py() or m.as_py()) for x, m in zip(table["ids"], table["minor"], strict=True)]))
            bits = (low != high)[place]
        parts = [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(counts)[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(parts, pa.binary())})

    return run


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, missing, sizes, texts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([missing], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "missing", "sizes", "text"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                ids.append((1 << 63) - 1 if i is None else i)
                missing.append(i is None)
                sizes.append(len(text))
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield block()
                    number += 1
                    ids, missing, sizes, texts, held = [], [], [], [], 0
        if ids:
            yield block()

    return run


def _write_blocks(docs: DataFrame, block_bytes: int, total: int) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed by block: joins on it leave the texts where they are. The
    catalog's entry goes at once; the files stay. The number of buckets follows the bytes of text up to the largest
    that Spark allows, beyond which a task reads more blocks one after the other."""
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as binary) as text")
    blocks = source.mapInArrow(_pack(block_bytes), "block bigint, doc_ids array<bigint>, missing array<boolean>, sizes array<int>, text binary")
    name = f"quarry_blocks_{uuid.uuid4().hex}"
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TABLE_BYTES))
    buckets = min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")), wanted)
    dealt = blocks.repartition(buckets, "block")  # one file a bucket
    dealt.write.format("parquet").option("compression", "zstd").option("path", shared_path(spark, "suffix-blocks")).bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _settled(docs: DataFrame, length: int, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, Rounds]:
    """The blocks with the replies of all rounds, and the work that is left."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    known = _write_blocks(docs, block_bytes, total)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes)
    for k in (1, 2, 3):
        entries = known.mapInArrow(Rounds(length, buckets, k - 1).entries, "bucket bigint, block bigint, major binary, minor binary, base bigint, ids binary")
        replies = write_shared(entries.groupBy("bucket").applyInArrow(_sort_bucket(k, buckets), _REPLY), f"suffix-replies-{k}")
        by_block = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"r{k}"))
        known = known.join(by_block.hint("merge"), "block", "left")  # the blocks' side is bucketed: no exchange
    return known, Rounds(length, buckets, 3)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every whole text as UTF-8 bytes; ``spans`` are
    the removed runs as byte offsets, end exclusive.

    Removed is each byte covered by a ``length``-byte string that also starts in a document of smaller doc_id, judged
    on the input. A null text is empty; a null doc_id counts as larger than all others; rows of equal doc_id remove
    nothing from each other; an empty table gives no rows; other columns are ignored. Names have 64 bits, and a string
    is judged by its place in a bucket and two of them. What a task holds is a block and what is sent for it, so a
    text longer than ``block_bytes`` is a block of its own, and a few bytes for each tenth of its bytes besides.
    """
    known, last = _settled(docs, length, block_bytes, bucket_bytes)
    return known.mapInArrow(last.result, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def remaining_texts(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, text)`` without the removed bytes, one row a row of ``docs``, repeated and null doc_ids included; a
    null text is empty. What is left of a character cut in half is replaced as decoding does."""
    known, last = _settled(docs, length, block_bytes, bucket_bytes)
    return known.mapInArrow(last.texts, "doc_id bigint, text string")
