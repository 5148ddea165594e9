"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, SAFE, SPACE
from .common import write_shared

#: Besides what lies outside the safe code points, the capital sigma, which the libraries lower-case differently.
_UNSAFE = re.compile(f"[^{SAFE}]|Σ")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def word_pieces(text: str, tokenizer, special: re.Pattern, names: frozenset[str]) -> list[str]:
    """The pre-tokens of ``text`` after normalisation; special strings stand for themselves."""
    out: list[str] = []
    for part in special.split(text) if "<" in text else (text,):
        if part in names:
            out.append(part)
        elif not _UNSAFE.search(part):
            out += _WORDS.findall(unicodedata.normalize("NFC", part).lower())
        else:
            plain = tokenizer.normalizer.normalize_str(part)
            out += [plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
    return out


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of uint32 values, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


_BLOCK = "block bigint, doc_ids array<bigint>, n_bytes array<bigint>, sizes binary, pieces binary, times binary, words array<string>"


def _frequencies(vocabulary: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        names = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        special, named = re.compile("(" + "|".join(map(re.escape, names)) + ")"), frozenset(names)
        seq = TaskContext.get().partitionId() << 32

        def emit(ids, lengths, sizes, pieces, times, words):
            cols = [[seq], [ids], [lengths], [_pack(np.array(sizes, np.uint32))], [_pack(np.concatenate(pieces) if pieces else np.empty(0, np.uint32))], [_pack(np.concatenate(times) if times else np.empty(0, np.uint32))], [list(words)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "doc_ids", "n_bytes", "sizes", "pieces", "times", "words"])

        ids, lengths, sizes, pieces, times, words, held = [], [], [], [], [], {}, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = Counter(word_pieces(text, tok, special, named))
                at = np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found))
                many = np.fromiter(found.values(), np.uint32, len(found))
                order = np.argsort(at)
                at = at[order]
                pieces.append(np.diff(at, prepend=np.uint32(0)))
                times.append(many[order])
                n = len(text.encode())
                ids.append(i)
                lengths.append(n)
                sizes.append(len(found))
                held += n
                if held >= block_bytes:
                    yield emit(ids, lengths, sizes, pieces, times, words)
                    seq += 1
                    ids, lengths, sizes, pieces, times, words, held = [], [], [], [], [], {}, 0
        if ids:
            yield emit(ids, lengths, sizes, pieces, times, words)

    return run


def _count_pieces(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = [len(e.ids) for k in range(0, len(words), 4096) for e in tok.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["word", "n"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            take = lambda name: batch.column(name)[row]  # noqa: E731, B023
            sizes, steps, times = (_unpack(take(c).as_py()) for c in ("sizes", "pieces", "times"))
            counts = take("counts").values
            table = np.zeros(len(counts) + 1, np.int64)
            if len(counts):
                table[counts.field("at").to_numpy(zero_copy_only=False)] = counts.field("n").to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            run = np.cumsum(steps, dtype=np.int64)
            before = np.concatenate([[0], run])[ends - sizes]  # gaps restart in each document
            place = run - np.repeat(before, sizes)
            total = np.concatenate([[0], np.cumsum(table[place] * times)])
            n = total[ends] - total[ends - sizes]
            yield pa.RecordBatch.from_arrays([take("doc_ids").values, take("n_bytes").values, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text as the tokenizer file's library counts it.

    Documents are dealt into blocks as they are scanned; a block keeps its own dictionary of pre-tokens and, for each
    document, places and frequencies in it. The distinct pre-tokens of all blocks are tokenised once each, joined to
    the blocks' dictionaries, and summed per document; ids are never built per document. A very common pre-token has
    one row a block, so no key grows with the number of documents. A null text is empty: 0 bytes, 0 tokens. Repeated
    rows are counted each; an empty table gives no rows; other columns are ignored.
    """
    source = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"{text_col} as text")
    blocks = write_shared(source.mapInArrow(_frequencies(vocabulary, block_bytes), _BLOCK), "token-blocks")
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    counted = words.select("word").distinct().mapInArrow(_count_pieces(vocabulary), "word string, n int")
    replies = words.join(counted, "word").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    joined = blocks.drop("words").join(replies, "block", "left").withColumn("counts", F.coalesce("counts", F.expr("cast(array() as array<struct<at:int,n:int>>)")))
    summed = joined.mapInArrow(_sum, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
