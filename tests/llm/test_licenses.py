"""License scans: base phrases by regular expression, templates by expansion into regular expressions."""

import random
import re

import pytest

from quarrygraph.llm import licenses

SCHEMA = "doc_id long, text string"


def as_regex(template):
    """The same template as a regular expression over words that are each followed by a blank."""
    out = ""
    for m in re.finditer(r"\[|\]|\{(\d+)-(\d+)\}|[^\s\[\]{}]+", template):
        part = m.group(0)
        if part == "[":
            out += "(?:"
        elif part == "]":
            out += ")?"
        elif m.group(1):
            out += f"(?:[^ ]+ ){{{m.group(1)},{m.group(2)}}}"
        else:
            out += re.escape(part) + " "
    return out


def longest(regex, text, at):
    """End of the longest match at a place, by trying all ends."""
    ends = [m.end() for m in re.finditer(" ", text[at : at + 600])]
    return max((e for e in ends if re.fullmatch(regex, text[at : at + e])), default=0)


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    joined = "".join(w + " " for w in words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    hit, base, labels = set(), [], set()
    for i in range(len(words)):
        for phrase, label in licenses.PHRASES.items():
            size = len(phrase.split())
            if words[i : i + size] == phrase.split():
                base.append((i, label))
                hit |= set(range(i, i + size))
        for label, templates in licenses.TEMPLATES.items():
            for t in templates:
                size = longest(as_regex(t), joined, starts[i])
                if size:
                    labels.add(label)
                    hit |= set(range(i, i + joined[starts[i] : starts[i] + size].count(" ")))
    names = {x for _, x in base}
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), round(len(hit) / len(words), 9) if words else 0.0)


def got(frame):
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return {r.doc_id: tuple(r[c] for c in cols) for r in licenses.license_report(frame).collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    plain = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in re.findall("[a-z]+", t)} | {"éclair", "x1", "K"})
    made = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License. mit licenses MIT-LICENSE", "This work is licensed under the GNU General Public License, version 3, or (at your option) any later version", "Licensed under CC BY-NC 4.0", "cc  by cc by CC_BY ccby", "", None, "SPDX-License-Identifier: MIT", "Copyright (c) 2019 Some One. All rights reserved.", "copyright a b c d e f g h i all rights reserved", "mit license", "ÉMIT license mit licenseé", "K gnu general public GNU General\nPublic\tLicense"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choices(plain, k=rng.randint(0, 6))
            t = rng.choice([t for ts in licenses.TEMPLATES.values() for t in ts])
            t = re.sub(r"\{(\d+)-(\d+)\}", lambda m: " ".join(rng.choices(plain, k=rng.randint(int(m.group(1)), int(m.group(2)) + 1))), t)
            keep = rng.random()
            while "[" in t:
                t = re.sub(r"\[([^\[\]]*)\]", lambda m: m.group(1) if rng.random() < keep else "", t)
            parts += [w for w in t.split() if rng.random() > 0.01]
        made.append(" ".join(parts))
    return list(enumerate(made))


def test_against_regular_expressions(spark, texts):
    assert got(licenses.find_licenses(spark.createDataFrame(texts, SCHEMA))) == {i: brute(t) for i, t in texts}


def test_mandatory_wording_is_exact(spark):
    good = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction"
    rows = [(1, good), (2, good.replace("hereby", "herewith")), (3, good.replace("this software", " ".join(["w"] * 13)))]
    labels = {k: v[5] for k, v in got(licenses.find_licenses(spark.createDataFrame(rows, SCHEMA))).items()}
    assert labels == {1: "notice:mit", 2: "", 3: ""}


@pytest.mark.parametrize("bad", ["a [b", "a ] b", "a {3-2} b", "[a] {1-2}"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licenses.compiled(bad)


def test_empty_repeated_clashing_and_long(spark):
    assert got(licenses.find_licenses(spark.createDataFrame([], SCHEMA))) == {}
    long = "permission licensed under the copyright " * 100_000 + "mit license"
    table = spark.createDataFrame([(1, long, 0, 1), (1, long, 0, 1), (None, None, 0, 1)], SCHEMA + ", n_words int, `a.b` int")
    rows = licenses.find_licenses(table).select("doc_id", "n_base", "first_word", "score").collect()
    assert sorted(map(str, rows)) == sorted(map(str, [rows[0], rows[0], rows[-1]])) and len(rows) == 3
    assert {r.first_word for r in rows if r.doc_id == 1} == {500_000}
