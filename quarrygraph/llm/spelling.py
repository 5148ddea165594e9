"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MIN_CHARS = 6
MIN_COUNT = 5
#: A form has at least so many times the occurrences of its variant.
TIMES = 5
#: One run in so many, chosen by a hash of document and run, loses a code point; 0 for none.
TYPO_EVERY = 199
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Symbols of a reduced alphabet; all are letters, and digits stand for none of them.
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A form has five times the occurrences or more, and counts are below 2 ** 63: a chain has fewer than 28 links.
_DOUBLINGS = 5


def _count(typo_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                name = b"" if not doc.is_valid else str(doc.as_py()).encode()
                plain = text.as_py().encode().translate(_LOWER).decode() if text.is_valid else ""
                for word, n in Counter(_RUN.findall(plain)).items():
                    if typo_every:
                        h = zlib.crc32(name + b":" + word.encode())
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= MIN_CHARS:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    return run


def vocabulary_of(docs: DataFrame, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """``(word, n)`` of all words of ``MIN_CHARS`` code points or more that occur ``min_count`` times or more.

    Tasks count as they scan, so a common word is a few rows in the shuffle. A null text has no words; a null doc_id is
    hashed as an empty string; repeated rows count each.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    part = rows.mapInArrow(_count(typo_every), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols_for(words: int) -> int:
    """Size of the reduced alphabet: the least power of two, 4 to 32, that gives the shortest words a quarter as many
    reduced forms as there are words, so that a form stands for few words on average and has few neighbours."""
    size = 4
    while size < 32 and 4 * size**MIN_CHARS < words:
        size *= 2
    return size


def reduced(word: Column, symbols: int) -> Column:
    """Each letter replaced by one of ``symbols`` symbols that a hash of the letter picks."""
    return F.translate(word, LETTERS, "".join(_SYMBOLS[zlib.crc32(c.encode()) % symbols] for c in LETTERS))


def neighbourhood(word: Column, symbols: int) -> Column:
    """The strings over the reduced alphabet at most one edit from ``word`` that are no longer than it, itself included.
    The longer ones of a full neighbourhood are the same pairs seen from the other side: ``near_words`` turns them."""
    size = F.length(word)
    places = F.sequence(F.lit(1), size)

    def head(i: Column) -> Column:
        return F.substr(word, F.lit(1), i - 1)

    def tail(i: Column) -> Column:
        return F.substr(word, i + 1)

    letters = F.array(*[F.lit(s) for s in _SYMBOLS[:symbols]])
    fewer = F.transform(places, lambda i: F.concat(head(i), tail(i)))
    other = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(word), fewer, other))


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``(word, near, near_n)``: of ``words(word, n)`` with distinct words, each pair at exactly one inserted, deleted or
    replaced code point, in both directions.

    Two words one edit apart have reduced forms at most one edit apart, whatever the alphabet, so nothing is lost: the
    neighbourhoods of the distinct reduced forms, each pair of unequal lengths from its longer form, meet the reduced
    vocabulary, and the words behind two forms that met
    are compared as they are while they are joined. No pair that fails leaves the join.
    """
    size = symbols or symbols_for(words.count())
    known = write_shared(words.withColumn("form", reduced(F.col("word"), size)), "spelling-words")
    forms = known.select("form").distinct()
    around = forms.select("form", F.explode(neighbourhood(F.col("form"), size)).alias("other"))
    met = around.join(forms.select(F.col("form").alias("other")), "other")
    left = known.join(met, "form")
    right = known.select(F.col("form").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein(left["word"], right["near"], 1) == 1
    pairs = left.join(right, (left["other"] == right["other"]) & one_edit)
    there = F.struct("word", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    turned = F.when(F.length("word") > F.length("near"), F.array(there, back)).otherwise(F.array(there))
    return pairs.select(F.explode(turned).alias("pair")).select("pair.*")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links(word, form)`` by pointer doubling."""
    links = write_shared(links, "spelling-links")
    for _ in range(_DOUBLINGS):
        on = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        links = write_shared(links.join(on, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "spelling-links")
    return links.withColumnRenamed("form", "root")


def spelling_groups(docs: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES, typo_every: int = TYPO_EVERY, symbols: int | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary of ``docs(doc_id, text)``.

    ``form`` is the near word of largest n (ties: the first in code-point order) if it has at least ``times`` times the
    occurrences, else null; ``root`` is where the chain of forms ends. ``n_near`` counts the near words. Words are
    lower-cased in A-Z only. Null texts have no words; an empty table gives no rows; repeated rows count each; other
    columns are ignored.
    """
    words = write_shared(vocabulary_of(docs, min_count, typo_every), "spelling-vocabulary")
    near = near_words(words, symbols)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * times
    joined = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.form")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    joined = write_shared(joined, "spelling-forms")
    roots = _roots(joined.where("form is not null").select("word", "form"))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
