"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarrygraph.llm import spelling

SCHEMA = "doc_id long, text string"


def brute(rows, typo_every=199, min_count=5, times=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, many = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        many[w] = len(others)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, many[w], words.get(form[w])))
    return sorted(out, key=str)


def got(frame):
    cols = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(r[c] for c in cols) for r in frame.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcéÿ÷xyz") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = list(stems)
    for s in stems:
        for _ in range(4):
            k = rng.randrange(len(s))
            words += [s[:k] + s[k + 1 :], s[:k] + rng.choice("abcé") + s[k:], s[:k] + rng.choice("abcé") + s[k + 1 :]]
    chain = ["letters"] * 700 + ["lettars"] * 130 + ["lettarx"] * 26 + ["lettaqx"] * 5
    out = [(i, " ".join(rng.choices(words, weights=[80] * 40 + [2] * (len(words) - 40), k=300)).title()) for i in range(60)]
    return [*out, (100, " ".join(chain)), (101, None), (102, ""), (None, "Letters, LETTERS-letters"), (100, " ".join(chain[:9]))]


@pytest.mark.parametrize("symbols", [None, 2, 32])
def test_against_brute_force(spark, rows, symbols):
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), symbols=symbols)) == brute(rows)


def test_many_typos(spark, rows):
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), typo_every=3)) == brute(rows, typo_every=3)


def test_chain_ends_at_its_root(spark, rows):
    found = {w: (form, root) for w, form, root, *_ in got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), typo_every=0))}
    assert found["lettaqx"] == ("lettarx", "letters") and found["letters"] == (None, "letters")


def test_empty_clashing_and_long(spark):
    assert got(spelling.spelling_groups(spark.createDataFrame([], SCHEMA))) == []
    long = "wonderful " * 200_000 + "wonderfull " * 9 + "x" * 300_000
    table = spark.createDataFrame([(1, long, 1, "f", 2), (1, long, 1, "f", 2)], SCHEMA + ", n int, form string, `a.b` int")
    assert got(spelling.spelling_groups(table)) == brute([(1, long), (1, long)])
