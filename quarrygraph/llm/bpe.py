"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token's symbols are the leaves' neighbours: leaf ``i`` holds ``rank << bits | i`` of the pair that starts
at symbol ``i``. The tree, 32 children to a node, keeps minima, so its root is the leftmost pair of the lowest rank; a
merge changes at most three leaves and their ancestors, in logarithmic time. Merging goes on until the root says that no pair is mergeable.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Code points for which the installed regular-expression tables and the tokenizer library agree and that need no
#: library fallback: below the Armenian block, general punctuation, currency signs.
SAFE = "\x00-ԯ -⁯₠-₿"
_UNSAFE = re.compile(f"[^{SAFE}]")
_NONE = 1 << 62
#: Children of a tree node: minima of so many are taken at once by a built-in.
_SHIFT = 5
_FAN = 1 << _SHIFT


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space among the safe code points, as bodies of character classes."""
    points = [chr(c) for c in (*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0))]
    out = []
    for p in (r"\p{L}", r"\p{N}", r"\s"):
        hit = regex.compile(p).match
        inside, spans = [ord(c) for c in points if hit(c)], []
        for c in inside:
            if spans and c == spans[-1][1] + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans))
    return tuple(out)


LETTER, NUMBER, SPACE = _classes()
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_symbols(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Applies the merges to ``ids``, lowest rank first, leftmost first; ``pairs[left << 32 | right]`` is
    ``rank << 32 | merged``."""
    n = len(ids)
    if n < 2:
        return ids
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get = pairs.get
    found = [get(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
    leaves = [_NONE if hit is None else (hit >> 32) << bits | i for i, hit in enumerate(found)]
    tree = [leaves]
    while len(tree) == 1 or len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([min(below[k : k + _FAN]) for k in range(0, len(below), _FAN)])
    root = tree[-1]
    ids = list(ids)
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    while (low := root[0]) < _NONE:
        i = low & mask
        j = following[i]
        ids[i] = merged = pairs[ids[i] << 32 | ids[j]] & 0xFFFFFFFF
        ids[j] = -1
        k = following[i] = following[j]
        leaves[i] = _NONE
        if k < n:
            previous[k] = i
            leaves[j] = _NONE
            if (hit := get(merged << 32 | ids[k])) is not None:
                leaves[i] = (hit >> 32) << bits | i
        else:
            j = i
        h = previous[i]
        if h >= 0:
            hit = get(ids[h] << 32 | merged)
            leaves[h] = _NONE if hit is None else (hit >> 32) << bits | h
        else:
            h = i
        below = leaves
        for level in tree[1:]:  # the ancestors of the three changed leaves
            h >>= _SHIFT
            i >>= _SHIFT
            j >>= _SHIFT
            level[i] = min(below[i << _SHIFT : (i + 1) << _SHIFT])
            if h != i:
                level[h] = min(below[h << _SHIFT : (h + 1) << _SHIFT])
            if j != i:
                level[j] = min(below[j << _SHIFT : (j + 1) << _SHIFT])
            below = level
    return [x for x in ids if x >= 0]


#: Ids as text joined by commas, their number, and the bytes that decoding them gives.
Piece = tuple[str, int, bytes]


class ByteBpe:
    """A byte-level BPE vocabulary file (JSON) with its merges. ``pieces`` are pre-tokens; their encodings are
    kept in a cache of two generations of at most ``cache_size`` entries each, which changes speed only."""

    def __init__(self, path: str, cache_size: int = 150_000):
        spec = json.load(open(path, encoding="utf-8"))
        model, kind = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"] or model["byte_fallback"] or model["ignore_merges"] or model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        vocab = model["vocab"]
        self.start = [vocab[alphabet[b]] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.cache_size, self._library = path, cache_size, None
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if not _UNSAFE.search(text):
            return _FAST.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_piece(self, piece: str) -> list[int]:
        start = self.start
        return merge_symbols([start[b] for b in piece.encode()], self.pairs)

    def _known(self, piece: str) -> Piece:
        made = self.old.get(piece)
        if made is None:
            made = self._piece(self.encode_piece(piece))
        if len(self.young) >= self.cache_size:
            self.old = dict(self.young)
            self.young.clear()
        if len(piece) <= 64:
            self.young[piece] = made
        return made

    def _piece(self, ids: list[int]) -> Piece:
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def parts(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.split_special and "<" in text else [text]

    def pieces(self, text: str) -> list[Piece]:
        """The encoded pre-tokens and special strings of ``text``, in order."""
        known, make, out = self.young, self._known, []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self._piece([self.special[part]]))
            else:
                out += [known.get(piece) or make(piece) for piece in self.pre_tokens(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids(self.pieces(text)).tolist()

    @staticmethod
    def ids(pieces: list[Piece]) -> np.ndarray:
        return np.fromstring(",".join([p[0] for p in pieces]), np.int32, sep=",")

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from the ids."""
        pieces = self.pieces(text)
        ids = ",".join([p[0] for p in pieces])
        decoded = b"".join([p[2] for p in pieces]).decode("utf-8", "replace").encode()
        return sum([p[1] for p in pieces]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


_loaded: dict[tuple[str, int], ByteBpe] = {}


def load(path: str, cache_size: int) -> ByteBpe:
    if (path, cache_size) not in _loaded:
        _loaded[path, cache_size] = ByteBpe(path, cache_size)
    return _loaded[path, cache_size]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 150_000) -> DataFrame:
    """``(doc_id, n_tokens, ids ARRAY<INT>, round_trip)``: the token ids of every whole text, and whether decoding
    them gives the text again. A null text is empty: no ids. Rows repeat as given, other columns are dropped, an empty
    table gives no rows. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, cache_size)
        for batch in batches:
            n, packed, same = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                pieces = bpe.pieces(text)
                n.append(sum([p[1] for p in pieces]))
                packed.append(bpe.ids(pieces))
                same.append(b"".join([p[2] for p in pieces]) == text.encode())
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*packed, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    source = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"{text_col} as text")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, 1)
        for batch in batches:
            texts = [bpe.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 400_000) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text, encoded and decoded piece by piece:
    what a run needs to be compared without moving the ids. A null text is empty (no ids, digests of nothing);
    rows repeat as given; an empty table gives no rows. No shuffle; memory is one text and the piece cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, cache_size)
        for batch in batches:
            rows = [bpe.digest(t.as_py() or "") for t in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"{text_col} as text")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
