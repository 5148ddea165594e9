"""Phrase collocations: prefixes of words grouped by a memory budget, and a suffix subtree of bounded depth a group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
#: Suffixes that a group's subtree may hold; a word prefix with more is replaced by its extensions.
BUDGET = 2 << 20
#: Bytes of text a block of the scan holds.
BLOCK_BYTES = 16 << 20
#: Bytes of a text that are looked at together.
PIECE_BYTES = 1 << 20
#: Words of a block whose suffixes a task holds together.
SLICE_WORDS = 1 << 19
#: Words of blocks that a task counts together.
BUCKET_WORDS = 1 << 19
#: Counters of word pairs: one for so many words, at most two to the second power in all; two to the third in a task's sum.
PAIR_SHARE, PAIR_BITS, RANGE_BITS = 16, 27, 18
_MAP = bytearray(b + 32 if 65 <= b <= 90 else b for b in range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _MAP[_c] = 10
_MAP[9] = 32
_BLOCK = "block bigint, lang string, words binary, times binary, n_words bigint, n bigint, stream binary"
_NUMBERED = "bucket bigint, block bigint, lang string, word string, f bigint, own bigint, known binary"
_NAMES = ["block", "lang", "words", "times", "n_words", "n", "stream"]
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of int64 values, compressed; planes of zeros cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").reshape(-1)


def _chunks(plain: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a prepared text and ``\\n`` for each break, a bounded part of the text at a time; a part ends at a
    break if there is one in reach."""
    at, size = 0, size or PIECE_BYTES
    while at < len(plain):
        to = plain.find(b"\n", at + size, at + 2 * size) + 1 or plain.find(b" ", at + size)
        to = len(plain) if to < 0 else to
        yield list(filter(None, plain[at:to].split(b" ")))
        at = to


class _Held:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []

    def add(self, found: list[bytes]) -> None:
        known = self.words
        self.parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))

    def end(self) -> None:
        self.parts.append(np.zeros(1, np.int32))

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        stream = np.concatenate(self.parts)
        times = np.bincount(stream, minlength=len(self.words))[1:]
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(list(self.words)[1:]))
        values = [block, lang, words, _pack(times), len(times), int(times.sum()), _pack(stream)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], names=_NAMES)


def _blocks(block_bytes: int, piece_bytes: int):
    """Words of ``block_bytes`` of text or a little more, numbered; a long text is cut at breaks, which no phrase crosses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, _Held] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = (text.as_py() or "").encode().translate(bytes(_MAP)).replace(b"\n", b" \n ")
                for found in _chunks(plain, piece_bytes):
                    held.setdefault(lang, _Held()).add(found)
                    size += sum(map(len, found))
                    if size >= block_bytes and found[-1:] == [b"\n"]:
                        yield from (h.row(seq, key) for key, h in held.items())
                        held, size, seq = {}, 0, seq + 1
                if lang in held:
                    held[lang].end()
                if size >= block_bytes:
                    yield from (h.row(seq, key) for key, h in held.items())
                    held, size, seq = {}, 0, seq + 1
        yield from (h.row(seq, key) for key, h in held.items())

    return run


def _shared_out(buckets: int):
    """A block's words with their places and times, dealt to ``buckets`` by a hash of language and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, packed, times in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                plain = zstandard.ZstdDecompressor().decompress(packed)
                words, times, seed = plain.split(b"\n") if plain else [], _unpack(times), zlib.crc32(lang.encode())
                bucket = np.fromiter((zlib.crc32(w, seed) for w in words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                cols: list[list] = [[], [], []]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    at = order[lo:hi]
                    cols[0].append(int(bucket[at[0]]))
                    cols[1].append(zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[i] for i in at.tolist()])))
                    cols[2].append(_pack(np.concatenate([np.diff(at, prepend=0), times[at]])))
                n = len(cols[0])
                arrays = [pa.array(cols[0], pa.int64()), pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "lang", "words", "at"])

    return run


def _numbered(min_count: int):
    """Of one bucket: a row for each word with ``min_count`` occurrences or more in its language, numbered from 0, and
    for each block the places and numbers of those that it holds."""

    def run(table: pa.Table) -> pa.Table:
        bucket, seen = table.column("bucket")[0].as_py(), 0
        out: dict[str, list] = {k.split()[0]: [] for k in _NUMBERED.split(", ")}

        def add(n: int, **values: list) -> None:
            for k, v in out.items():
                v += values.get(k, [None] * n)

        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            plain = [zstandard.ZstdDecompressor().decompress(b.as_py()).split(b"\n") for b in own.column("words")]
            held = pa.concat_arrays([pa.array(w, pa.binary()) for w in plain]).dictionary_encode()
            sizes = [len(w) for w in plain]
            del plain
            which = held.indices.to_numpy()
            places = [_unpack(b.as_py()).reshape(2, -1) for b in own.column("at")]
            times = np.zeros(len(held.dictionary), np.int64)
            np.add.at(times, which, np.concatenate([p[1] for p in places]))
            often = np.flatnonzero(times >= min_count)
            number = np.full(len(times), -1, np.int64)
            number[often] = np.arange(seen, seen + len(often))
            add(len(often), bucket=[bucket] * len(often), lang=[lang] * len(often), word=held.dictionary.take(pa.array(often)).cast(pa.string()).to_pylist(), f=times[often].tolist(), own=number[often].tolist())
            seen += len(often)
            lo = 0
            for block, n, (gaps, _) in zip(own.column("block").to_pylist(), sizes, places, strict=True):
                ids = number[which[lo : lo + n]]
                lo += n
                if (ids >= 0).any():
                    add(1, bucket=[bucket], block=[block], lang=[lang], known=[_pack(np.concatenate([np.cumsum(gaps)[ids >= 0], ids[ids >= 0]]))])
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.table({k.split()[0]: pa.array(out[k.split()[0]], kinds[k.split()[1]]) for k in _NUMBERED.split(", ")})

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of a block's own numbers to streams of vocabulary ids; a break or a rare word is 0."""
    for batch in batches:
        for blob, replies in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            stream = _unpack(blob.as_py())
            table = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
            for reply in replies:
                at, own = _unpack(reply["known"]).reshape(2, -1)
                table[at + 1] = own + reply["offset"]
            yield pa.RecordBatch.from_arrays([pa.array([_pack(table[stream])], pa.binary())], names=["stream"])


def _counter(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The counter, of two to the power ``bits``, of each pair of words that follow one another."""
    return (_mixed(_mixed(left) + right.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _pairs(bits: int, min_count: int, words: int):
    """What a task adds to the counters of word pairs, by ranges of counters; no sum counts beyond ``min_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.uint16 if min_count < 1 << 15 else np.int64)
        for stream in (_unpack(blob.as_py()) for batch in batches for blob in batch.column(0)):
            for lo in range(0, len(stream), words):
                left, right = stream[lo : min(lo + words, len(stream) - 1)], stream[lo + 1 : lo + words + 1]
                both = (left > 0) & (right > 0)
                at, n = np.unique(_counter(left[both], right[both], bits), return_counts=True)
                sums[at] = np.minimum(sums[at] + np.minimum(n, min_count), min_count)
        wide = min(bits, RANGE_BITS)
        for k in range(1 << bits - wide):
            part = sums[k << wide : k + 1 << wide]
            at = np.flatnonzero(part)
            if len(at):
                blob = _pack(np.concatenate([np.diff(at, prepend=0), part[at].astype(np.int64)]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([blob], pa.binary())], names=["k", "sums"])

    return run


def _frequent(bits: int, min_count: int):
    """The counters of a range that reach ``min_count``, a bit each."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << min(bits, RANGE_BITS), np.int64)
        for blob in table.column("sums"):
            gaps, n = _unpack(blob.as_py()).reshape(2, -1)
            sums[np.cumsum(gaps)] += n
        return pa.table({"k": table.column("k")[:1], "bits": pa.array([np.packbits(sums >= min_count).tobytes()], pa.binary())})

    return run


def _pair_filter(coded: DataFrame, total: int, min_count: int, words: int) -> tuple[int, np.ndarray]:
    """Counters of pairs, as a power of two, and a bit for each: whether its pairs occur ``min_count`` times or more in sum.
    A pair that does has its bit set; some of the others share it. At most 16 MB, whatever the input."""
    bits = min(PAIR_BITS, max(3, (total // PAIR_SHARE).bit_length()))
    wide = min(bits, RANGE_BITS)
    found = np.zeros(1 << bits - 3, np.uint8)
    sums = coded.mapInArrow(_pairs(bits, min_count, words), "k bigint, sums binary").groupBy("k")
    for k, some in sums.applyInArrow(_frequent(bits, min_count), "k bigint, bits binary").collect():
        found[k << wide - 3 : k + 1 << wide - 3] = np.frombuffer(some, np.uint8)
    return bits, found


def _suffixes(stream: np.ndarray, depth: int, words: int, pairs: tuple[int, np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Columns of the suffixes of two words or more, cut at ``depth`` words and before the first pair of words that is
    known to be rare; 0 after the end. Those that start in the same ``words`` words come together."""
    bits, found = pairs
    for at in range(0, len(stream), words):
        n = min(words, len(stream) - at)
        padded = np.concatenate([stream[at : at + n + depth], np.zeros(depth, np.int64)])
        often = (padded[:-1] > 0) & (padded[1:] > 0)
        some = np.flatnonzero(often)
        counter = _counter(padded[some], padded[some + 1], bits)
        often[some] = (found[counter >> 3] >> (7 - (counter & 7)).astype(np.uint8)) & 1 > 0
        starts = np.flatnonzero(often[:n])
        cols = [padded[starts]]
        for k in range(1, depth):
            cols.append(np.where((cols[-1] > 0) & often[starts + k - 1], padded[starts + k], 0))
        yield cols


def _place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + the place of each key in a sorted table, or 0."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at + 1, 0)


def _below(tables: list[np.ndarray], base: int, depth: int, words: int, pairs: tuple[int, np.ndarray]):
    """Counts of the extensions, by a word, of the longest prefixes that ``tables`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in (c for batch in batches for blob in batch.column(0) for c in _suffixes(_unpack(blob.as_py()), depth, words, pairs)):
            parent = np.zeros(len(cols[0]), np.int64)
            live = np.arange(len(cols[0]))
            for k, table in enumerate(tables):
                found = _place(table, parent[live] * base + cols[k][live])
                live = live[found > 0]
                parent[live] = found[found > 0]
            live = live[cols[len(tables)][live] > 0]
            keys, n = np.unique(parent[live] * base + cols[len(tables)][live], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "f"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number of each number."""
    y = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(31))


def _deal(tables: list[np.ndarray], base: int, depth: int, groups: int, words: int, pairs: tuple[int, np.ndarray]):
    """Suffixes of a slice of a block dealt to the groups of their prefixes, equal ones as one with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in (c for batch in batches for blob in batch.column(0) for c in _suffixes(_unpack(blob.as_py()), depth, words, pairs)):
            size = len(cols[0])
            parent, key, length = np.zeros(size, np.int64), cols[0].copy(), np.ones(size, np.int64)
            live = np.arange(size)
            for k, table in enumerate(tables):
                found = _place(table, parent[live] * base + cols[k][live])
                live = live[found > 0]
                parent[live] = found[found > 0]
                key[live] = parent[live] * base + cols[k + 1][live]
                length[live] = k + 2
                ended = cols[k + 1][live] == 0  # the prefix itself is counted already
                length[live[ended]] = 0
                live = live[~ended]
            keep = length > 0
            group = (_mixed(_mixed(key[keep]) + length[keep].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            cols = [c[keep] for c in cols]
            order = np.lexsort((*reversed(cols), group))
            rows = [group[order], length[keep][order], *(c[order] for c in cols)]
            if not len(order):
                continue
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in (rows[0], *rows[2:]):
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            rows = [np.diff(np.append(at, len(order))), *(c[at] for c in rows)]
            ends = np.flatnonzero(np.diff(rows[1], append=-1)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(ends), 1024):
                some = list(zip(starts[lo : lo + 1024], ends[lo : lo + 1024], strict=True))
                blobs = [_pack(np.concatenate([rows[0][a:b], *(c[a:b] for c in rows[2:])])) for a, b in some]
                yield pa.RecordBatch.from_arrays([pa.array([int(rows[1][a]) for a, _ in some], pa.int64()), pa.array(blobs, pa.binary())], names=["grp", "rows"])

    return run


def _subtree(base: int, depth: int, min_count: int):
    """Nodes of two words or more of one group's suffix subtree with ``min_count`` leaves or more. Level by level, a
    node's leaves are summed; below a node with fewer leaves nothing is built."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()).reshape(depth + 2, -1) for b in table.column("rows")]
        count, length, *cols = np.concatenate(parts, axis=1)
        del parts
        phrases: list[list[int]] = []
        totals: list[int] = []
        node = cols[0]
        for d in range(1, depth + 1):
            if d > 1:
                alive = cols[d - 1] > 0
                count, length, node = count[alive], length[alive], node[alive]
                cols = [c[alive] for c in cols]
                node = node * base + cols[d - 1]
            _, first, node = np.unique(node, return_index=True, return_inverse=True)
            leaves = np.bincount(node, weights=count, minlength=len(first)).astype(np.int64)
            often = leaves >= min_count
            given = np.flatnonzero(often & (length[first] <= d)) if d > 1 else []
            if len(given):
                phrases += np.stack([c[first[given]] for c in cols[:d]], axis=1).tolist()
                totals += leaves[given].tolist()
            stay = (often | (length[first] > d))[node]
            count, length, node = count[stay], length[stay], node[stay]
            cols = [c[stay] for c in cols]
        return pa.table({"p": pa.array(phrases, pa.list_(pa.int64())), "f": pa.array(totals, pa.int64())})

    return run


def _vocabulary(blocks: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, word, id, f)`` of the words with ``min_count`` occurrences or more in their language, ids from 1; and for
    each block ``(block, lang, replies)``, the ids of those that it holds. Words travel once, packed by bucket."""
    buckets = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    dealt = blocks.select("block", "lang", "words", "times").mapInArrow(_shared_out(buckets), "bucket bigint, block bigint, lang string, words binary, at binary")
    some = write_shared(dealt.groupBy("bucket").applyInArrow(_numbered(min_count), _NUMBERED), "phrases-numbered")
    before, offsets = 1, []
    for bucket, n in sorted(map(tuple, some.where("word is not null").groupBy("bucket").count().collect())):  # one row a bucket
        offsets.append((bucket, before))
        before += n
    some = some.join(F.broadcast(blocks.sparkSession.createDataFrame(offsets, "bucket bigint, offset bigint")), "bucket")
    words = some.where("word is not null").select("lang", "word", (F.col("offset") + F.col("own")).alias("id"), "f")
    replies = some.where("known is not null").groupBy("block", "lang").agg(F.collect_list(F.struct("offset", "known")).alias("replies"))
    return words, replies


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, slice_words: int = SLICE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, phrases and languages of ``docs(lang, text)``: ``(lang, word, id, f)``, ``(p, f)`` with ``p`` the array of
    the word ids of each phrase of 1 to ``depth`` words that occurs ``min_count`` times or more in a language, and
    ``(lang, n)``.

    A word of a phrase that is frequent is frequent, so rarer words end a suffix; so do pairs of words whose counter,
    which other pairs may share, stays below ``min_count``. Prefixes of one word are counted first; one with more than ``budget`` occurrences is replaced by its extensions by a word, and so on, so that each
    prefix fits; there are at most occurrences / ``budget`` such prefixes, which is what the driver holds. The
    prefixes are dealt to groups by hash, half a budget each on average, a group's suffixes are brought together in
    packed arrays, and its subtree is built alone. Equal suffixes of ``slice_words`` words of a block are one, so a phrase
    of any frequency is at most one row a slice. A text longer than a block is cut at its breaks. Beyond about 10**12 words a block sends few suffixes to each of many groups, and its rows
    are then bounded by its suffixes only.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").alias("text"))
    blocks = write_shared(source.mapInArrow(_blocks(block_bytes, piece_bytes), _BLOCK), "phrases-blocks")
    langs = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    words, replies = _vocabulary(blocks, min_count)
    told = blocks.select("block", "lang", "stream").join(replies, ["block", "lang"]).select("stream", "replies")
    coded = write_shared(told.mapInArrow(_coded, "stream binary"), "phrases-coded")

    size = words.agg(F.sum("f").alias("total"), F.max("id").alias("ids")).first()
    total, base = size["total"] or 0, (size["ids"] or 0) + 1
    pairs = _pair_filter(coded, total, min_count, slice_words)
    tables: list[np.ndarray] = []
    paths: list[list[int]] = []
    heavy_nodes: list[tuple[list[int], int]] = []
    level = words.select(F.col("id").alias("key"), "f")
    for k in range(depth - 1):
        heavy = sorted(map(tuple, level.where(F.col("f") > budget).select("key", "f").collect()))
        if not heavy:
            break
        paths = [[*(paths[key // base - 1] if k else []), key % base] for key, _ in heavy]
        tables.append(np.array([key for key, _ in heavy], np.int64))
        if k:
            heavy_nodes += [(p, f) for p, (_, f) in zip(paths, heavy, strict=True) if f >= min_count]
        level = coded.mapInArrow(_below(list(tables), base, depth, slice_words, pairs), "key bigint, f bigint").groupBy("key").agg(F.sum("f").alias("f"))
    groups = max(1, -(-2 * total // budget))
    dealt = coded.mapInArrow(_deal(tables, base, depth, groups, slice_words, pairs), "grp bigint, rows binary")
    nodes = dealt.groupBy("grp").applyInArrow(_subtree(base, depth, min_count), "p array<bigint>, f bigint")
    nodes = nodes.unionByName(spark.createDataFrame(heavy_nodes, "p array<bigint>, f bigint"))
    nodes = nodes.unionByName(words.select(F.array("id").alias("p"), "f"))
    return words, write_shared(nodes, "phrases-nodes"), write_shared(langs, "phrases-langs")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, percent: int = 100, top: int = TOP, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language of ``docs(lang, text)``.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends. A phrase of 2 to ``depth`` words that
    occurs ``a`` >= ``min_count`` times is scored floor(1000 * a * n / (l * r)) at its lowest-scoring cut, exactly; it
    is dropped if it stands inside a longer one that occurs at least ``percent`` in a hundred as often. Null languages
    are ``und``; null texts are empty; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    words, nodes, langs = phrase_counts(docs, min_count, depth, budget, block_bytes, piece_bytes, slice_words)
    size = F.size("p")
    of = words.select(F.col("id").alias("head"), "lang").join(langs, "lang")
    found = nodes.where(size > 1).select("p", F.col("f").alias("a"))
    cuts = found.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("p1"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("p2"), F.get("p", F.lit(0)).alias("head"))
    cuts = cuts.join(nodes.select(F.col("p").alias("p1"), F.col("f").alias("l")), "p1").join(nodes.select(F.col("p").alias("p2"), F.col("f").alias("r")), "p2").join(of, "head")
    # up to 10**15 occurrences of a phrase and 10**17 words: 38 digits
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cuts.withColumn("score", exact.cast("bigint")).groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda d: F.transform(F.sequence(F.lit(1), size - d + 1), lambda i: F.slice("p", i, d))))
    over = found.where(size > 2).select(F.explode(inner).alias("p"), "a").groupBy("p").agg(F.max("a").alias("over"))
    left = scored.join(over, "p", "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * percent))
    spelled = left.select("p", F.posexplode("p").alias("pos", "id")).join(words.select("id", "word"), "id").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    named = left.join(spelled, "p").select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM low),
parts AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM parts GROUP BY lang),
placed AS (SELECT lang, ws, g, unnest(range(1, len(ws) - g + 2)) AS i FROM parts, (SELECT unnest([1, 2, 3, 4, 5]) AS g)),
grams AS (SELECT lang, g, array_to_string(ws[i : i + g - 1], ' ') AS p, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, g, p, f AS a, string_split(p, ' ') AS w FROM grams WHERE g >= 2),
cuts AS (SELECT *, unnest(range(1, g)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.g, c.p, c.a, c.k, x.f AS l, y.f AS r, z.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * z.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN sizes z USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.p = array_to_string(c.w[1 : c.k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.p = array_to_string(c.w[c.k + 1 :], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, c.k) = 1
),
inside AS (SELECT lang, a, w, d, unnest(range(1, g - d + 2)) AS i FROM cand, (SELECT unnest([2, 3, 4]) AS d) WHERE d < g),
longer AS (SELECT lang, array_to_string(w[i : i + d - 1], ' ') AS p, max(a) AS m FROM inside GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.p) AS place
  FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.p = s.p
  WHERE o.m IS NULL OR 100 * o.m < 100 * s.a
)
SELECT lang, CAST(place AS BIGINT) AS rank, p AS phrase, a, l, r, n, score FROM ranked WHERE place <= 2000
"""
