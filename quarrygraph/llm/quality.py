"""Quality rules: base counts of every whole text and a calibrated, hashed n-gram logistic regression.

Texts are laid end to end in chunks of bytes and every measure is taken with whole-array operations. A prefix-sum
polynomial hash gives the hash of any word or line; feature weights are fixed-point integers, so a document's score
does not depend on which texts share its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Fixed decision threshold on the calibrated probability of being good.
KEEP_AT = 0.5
#: The classifier is fitted on at most this many labelled documents, those with the smallest hash of their doc_id.
FIT_ROWS = 2048
CHAR_N, BITS, SCALE, FIXED = 4, 16, 64.0, 1 << 20

_BASE, _ODD, _MIX = 0x9E3779B97F4A7C15 | 5, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE, _IS_SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_IS_SYMBOL[list(SYMBOLS)] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n + n // 4, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """What scoring and fitting need of some whole texts laid end to end."""

    n: int
    base: dict[str, np.ndarray]
    char_doc_count: np.ndarray
    char_at: np.ndarray
    char_lo: np.ndarray
    char_hi: np.ndarray
    word_at: np.ndarray
    word_lo: np.ndarray
    word_hi: np.ndarray
    pair_at: np.ndarray
    pair_doc: np.ndarray


def analyse(texts: list[bytes]) -> Chunk:
    k = len(texts)
    b = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, k)
    lo = np.cumsum(sizes + 1) - sizes
    hi = lo + sizes
    white = _IS_WHITE[b]
    turn = white[1:] != white[:-1]
    edges = np.flatnonzero(turn) + 1
    starts, ends = edges[0::2], edges[1::2]
    word_doc = np.searchsorted(lo, starts, "right") - 1
    n_words = np.bincount(word_doc, minlength=k)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[hi] - total[lo]

    pw, inv = powers(len(b) + 1)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * pw[: len(b)], out=prefix[1:])
    span = lambda s, e: _mix((prefix[e] - prefix[s]) * inv[s] + (e - s).astype(np.uint64) * _ODD)
    words = span(starts, ends)

    breaks = np.flatnonzero(b == 10)
    line_lo, line_hi = breaks[:-1] + 1, breaks[1:]
    full = np.searchsorted(starts, line_lo) < np.searchsorted(starts, line_hi)
    line_lo, line_hi = line_lo[full], line_hi[full]
    line_doc = np.searchsorted(lo, line_lo, "right") - 1
    key = _mix(span(line_lo, line_hi) + line_doc.astype(np.uint64) * _ODD)
    first = np.unique(key, return_index=True)[1]
    n_dup_lines = np.bincount(line_doc, minlength=k) - np.bincount(line_doc[first], minlength=k)

    n_repeat = np.zeros(k, np.int64)
    if len(words) >= 5:
        at = np.flatnonzero(word_doc[4:] == word_doc[:-4])
        key = words[at]
        for j in range(1, 5):
            key = key * _MIX + words[at + j]
        key = _mix(key + word_doc[at].astype(np.uint64) * _ODD)
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        n_repeat = np.bincount(word_doc[np.cumsum(cover)[:-1] > 0], minlength=k)

    base = {
        "n_words": n_words,
        "word_chars": per_text(~white & ((b & 0xC0) != 0x80)),
        "n_symbols": per_text(_IS_SYMBOL[b]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }
    wide = b.astype(np.uint32)
    gram = wide[: len(b) - 3] | wide[1 : len(b) - 2] << np.uint32(8) | wide[2 : len(b) - 1] << np.uint32(16) | wide[3:] << np.uint32(24) if len(b) > 3 else np.empty(0, np.uint32)
    char_at = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    char_lo = np.minimum(lo - 1, len(char_at))
    char_hi = np.maximum(char_lo, np.minimum(hi + 1 - (CHAR_N - 1), len(char_at)))
    word_lo = np.searchsorted(word_doc, np.arange(k))
    mate = np.flatnonzero(word_doc[1:] == word_doc[:-1])
    pair = _mix(words[mate] * _MIX + words[mate + 1])
    return Chunk(k, base, char_hi - char_lo, char_at, char_lo, char_hi, (words >> np.uint64(64 - BITS)).astype(np.int64), word_lo, word_lo + n_words, (pair >> np.uint64(64 - BITS)).astype(np.int64), word_doc[mate])


def _chunks(texts: list[bytes], chunk_bytes: int = 256 << 10) -> Iterator[tuple[int, Chunk]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= chunk_bytes or k == len(texts) - 1:
            yield first, analyse(texts[first : k + 1])
            first, size = k + 1, 0


@dataclass
class Model:
    """Fixed-point weights of the three feature families, bias, and the calibration's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, c: Chunk) -> np.ndarray:
        out = np.full(c.n, self.bias)
        for family, (at, lo, hi) in enumerate(((c.char_at, c.char_lo, c.char_hi), (c.word_at, c.word_lo, c.word_hi))):
            total = np.concatenate([[0], np.cumsum(self.weights[family][at], dtype=np.int64)])
            out += (total[hi] - total[lo]) * (SCALE / FIXED) / np.maximum(hi - lo, 1)
        many = np.bincount(c.pair_doc, minlength=c.n)
        stop = np.cumsum(many)
        total = np.concatenate([[0], np.cumsum(self.weights[2][c.pair_at], dtype=np.int64)])
        out += (total[stop] - total[stop - many]) * (SCALE / FIXED) / np.maximum(many, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -60, 60)))


KEEP_ALL = Model(np.zeros((3, 1 << BITS), np.int32), 0.0, 0.0, 60.0)


def fit(texts: list[bytes], good: np.ndarray, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-6) -> Model:
    """Logistic regression by Adam on three quarters of the rows, then Platt calibration on the rest. Without rows of
    both kinds the model keeps everything."""
    n = len(texts)
    if n == 0 or good.min() == good.max():
        return KEEP_ALL
    docs, ats, values = [], [], []
    for first, c in _chunks(texts):
        families = ((np.repeat(np.arange(c.n), c.char_hi - c.char_lo), np.concatenate([c.char_at[a:b] for a, b in zip(c.char_lo, c.char_hi, strict=True)])), (np.repeat(np.arange(c.n), c.word_hi - c.word_lo), c.word_at), (c.pair_doc, c.pair_at))
        for family, (doc, at) in enumerate(families):
            cell, times = np.unique(doc.astype(np.int64) << BITS | at.astype(np.int64), return_counts=True)
            doc = cell >> BITS
            docs.append((doc + first).astype(np.int32))
            ats.append(((cell & ((1 << BITS) - 1)) + (family << BITS)).astype(np.int32))
            values.append((times * SCALE / np.maximum(np.bincount(doc, times, minlength=c.n), 1)[doc]).astype(np.float32))
    doc, at, value = np.concatenate(docs), np.concatenate(ats), np.concatenate(values)
    held = np.arange(n) % 4 == 3
    if good[held].min(initial=1) == good[held].max(initial=0) or good[~held].min() == good[~held].max():
        held[:] = False
    share = good[~held].mean()
    each = np.where(held, 0.0, np.where(good == 1, 0.5 / share, 0.5 / (1 - share))) / max(1, (~held).sum())
    w, bias = np.zeros(3 << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[at] * value, minlength=n) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - good) * each
        g = np.append(np.bincount(at, off[doc] * value, minlength=len(w)) + ridge * w, off.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1] / SCALE
        bias -= step[-1]
    z = np.bincount(doc, w[at] * value, minlength=n) + bias
    rows = held if held.any() else ~held
    x, y = z[rows], good[rows].astype(float)
    a, o = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + o, -60, 60)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        da, do = np.linalg.solve(hess, [(g * x).sum(), g.sum()])
        a, o = a - float(np.clip(da, -1, 1)), o - float(np.clip(do, -1, 1))
    a = max(a, 1e-3)
    return Model(np.rint(w.reshape(3, -1) * FIXED).astype(np.int32), float(bias), a, o)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents, those whose doc_id hashes lowest (null ids, null labels and labels
    other than 0 and 1 are left out; of repeated labels the lowest counts; of repeated documents the first text in
    order). The sample is a bounded broadcast; one executor task fits and returns about 0.8 MB of weights."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("text", pa.binary())])).sort_by("doc_id")
        m = fit(table["text"].to_pylist(), table["quality"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.offset])], names=["weights", "bias", "slope", "offset"])

    one = texts.selectExpr("doc_id", "cast(quality as int) as quality", "cast(text as binary) as text").repartition(1)
    row = one.mapInArrow(run, "weights binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(bytes(row["weights"]), np.int32).reshape(3, -1), row["bias"], row["slope"], row["offset"]) if row else KEEP_ALL


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(texts: list[bytes], m: Model, keep_at: float) -> tuple[np.ndarray, ...]:
    c = analyse(texts)
    n, p = c.base["n_words"], m.probability(c)
    failed = (n < MIN_WORDS) | (100 * c.base["n_repeat_words"] > REPEAT_PERCENT * n)
    return (*(c.base[x].astype(np.int64) for x in _COLUMNS), failed, ~failed & (p >= keep_at), p)


def _judge_array(texts: pa.Array, m: Model, keep_at: float, chunk_bytes: int) -> list[pa.Array]:
    """The result columns for an array of binary texts, chunk by chunk."""
    parts, held, size = [_judge([b""], m, keep_at)], [], 0  # the first part gives the types and is dropped
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= chunk_bytes:
            parts.append(_judge(held, m, keep_at))
            held, size = [], 0
    if held:
        parts.append(_judge(held, m, keep_at))
    return [pa.array(np.concatenate(x)[1:]) for x in zip(*parts, strict=True)]


def keep_good(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, chunk_bytes: int = 256 << 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`quality_rules` keeps. No shuffle; only the text goes
    to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        return _judge_array(text, shared.value, keep_at, chunk_bytes)[-2]

    return docs.where(kept(F.col("text").cast("binary")))


def quality_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, chunk_bytes: int = 256 << 10) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability)`` of
    every whole text. A null text has no words and so fails the base rule; a null doc_id stays null; repeated rows
    are judged each; an empty table gives no rows; other columns are ignored. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _judge_array(batch.column(1), shared.value, keep_at, chunk_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_COLUMNS, "base_failed", "kept", "probability"])

    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in _COLUMNS) + ", base_failed boolean, kept boolean, probability double"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as binary) as text").mapInArrow(run, schema)
