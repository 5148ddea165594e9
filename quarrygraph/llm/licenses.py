"""License scans: notices written as templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices by label. ``[...]`` is optional, may nest and may be skipped as a whole; ``{a-b}`` stands for a to b words
#: of any kind, such as a name, a year or a version; all other wording is mandatory and must match word by word.
TEMPLATES = {
    "notice:apache-2.0": [
        "licensed under the apache license version 2 0 [the license]",
        "[you may not use this file except in compliance with the license] you may obtain a copy of the license at [http www apache org licenses license 2 0]",
    ],
    "notice:mit": [
        "[this {0-3} is] released under the mit license",
        "[this {0-3} is] licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of {1-12} to deal in the software without restriction",
    ],
    "notice:gpl": [
        "this {1-4} is licensed under the gnu general public license [version {1-2} [or [at your option] any later version]]",
        "this {1-4} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version {1-2} [of the license]",
    ],
    "notice:cc": [
        "licensed under [a] [the] cc by [nc] [sa] [nd] {1-2} 0 [international] [license]",
        "licensed under [a] [the] creative commons attribution [noncommercial] [sharealike] [noderivatives] {1-2} 0 [international] [unported] [license]",
    ],
    "notice:bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "notice:isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "notice:spdx": ["spdx license identifier {1-1} [{1-1} [only] [or later]]"],
    "notice:rights-reserved": ["copyright [c] {1-8} all rights reserved"],
}

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARK = re.compile(r"\[|\]|\{(\d+)-(\d+)\}|[^\s\[\]{}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.encode().translate(_LOWER).decode())


@dataclass
class Automaton:
    """States 0, 1, ...; state 0 starts. ``free`` are the steps without a word, ``any_`` those on any word."""

    word: list[dict[str, int]] = field(default_factory=list)
    any_: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.word.append({})
        self.any_.append(None)
        self.free.append([])
        return len(self.word) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        to = set()
        for s in states:
            if word in self.word[s]:
                to.add(self.word[s][word])
            if self.any_[s] is not None:
                to.add(self.any_[s])
        return self.closed(to) if to else frozenset()


def compiled(template: str) -> Automaton:
    """The automaton of one template. Unbalanced brackets, and regions without bounds in order, are errors."""
    a = Automaton()
    at = a.state()
    opened: list[int] = []
    spelled = 0
    for m in _MARK.finditer(template):
        part = m.group(0)
        if part == "[":
            opened.append(at)
            inner = a.state()
            a.free[at].append(inner)
            at = inner
        elif part == "]":
            if not opened:
                raise ValueError(f"closing bracket without its opening one: {template}")
            after = a.state()
            a.free[at].append(after)
            a.free[opened.pop()].append(after)
            at = after
        elif m.group(1) is not None:
            least, most = int(m.group(1)), int(m.group(2))
            if most < max(least, 1):
                raise ValueError(f"{part} takes no words: {template}")
            skips = []
            for k in range(most):
                if k >= least:
                    skips.append(at)
                to = a.state()
                a.any_[at] = to
                at = to
            for s in skips:
                a.free[s].append(at)
        else:
            to = a.state()
            a.word[at][part] = to
            at = to
            spelled += not opened
    if opened or not spelled:
        raise ValueError(f"open bracket, or no mandatory wording: {template}")
    a.end = at
    return a


class Scanner:
    """Finds base phrases and notices in a list of words; states reached from a set by a word are remembered."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.by_first: dict[str, list[tuple[list[str], str]]] = defaultdict(list)
        for parts, label in self.phrases:
            self.by_first[parts[0]].append((parts, label))
        self.automata = [(label, compiled(t)) for label, ts in templates.items() for t in ts]
        self.start: dict[str, list[int]] = defaultdict(list)
        self.steps: list[dict[tuple[frozenset[int], str], frozenset[int]]] = [{} for _ in self.automata]
        self.first = [a.closed({0}) for _, a in self.automata]
        self.known = []
        for k, (label, a) in enumerate(self.automata):
            if any(a.any_[s] is not None for s in self.first[k]):
                raise ValueError(f"a notice must start with wording: {label}")
            for w in sorted({w for s in self.first[k] for w in a.word[s]}):
                self.start[w].append(k)
            self.known.append({w for words in a.word for w in words})
        self.anchors = self.by_first.keys() | self.start.keys()

    def longest(self, k: int, words: list[str], i: int) -> int:
        """End of the longest text from ``i`` that automaton ``k`` accepts, or ``i``."""
        automaton, memo, states, end = self.automata[k][1], self.steps[k], self.first[k], i
        for j in range(i, len(words)):
            word = words[j] if words[j] in self.known[k] else ""  # all other words are alike to this automaton
            key = (states, word)
            if key not in memo:
                memo[key] = automaton.step(states, word)
            states = memo[key]
            if not states:
                break
            if automaton.end in states:
                end = j + 1
        return end

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """``(start, end, label)`` of base phrases and of notices, words counted from 0, ends exclusive."""
        base, notices = [], []
        for i, w in enumerate(words):
            if w not in self.anchors:
                continue
            for parts, label in self.by_first.get(w, ()):
                if words[i : i + len(parts)] == parts:
                    base.append((i, i + len(parts), label))
            for k in self.start.get(w, ()):
                end = self.longest(k, words, i)
                if end > i:
                    notices.append((i, end, self.automata[k][0]))
        return base, notices


def _covered(spans: list[tuple[int, int, str]]) -> int:
    total, until = 0, 0
    for start, end, _ in sorted(spans):
        total += max(0, end - max(start, until))
        until = max(until, end)
    return total


_OUT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<start:int,end:int,label:string>>"
_KINDS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("notices", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))]
)


def find_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices)``, one row a document.

    ``n_base`` counts the places where a base phrase stands, ``first_word`` and ``last_word`` are the smallest and the
    largest start. ``notices`` are the template matches: from each word that can start a template, the longest text its
    automaton accepts. ``labels`` joins base labels and notices' labels. ``score`` is the share of the words that lie
    in a base phrase or a notice, rounded to 9 places. A null or wordless text has no words, no labels, null places and
    score 0; repeated rows are answered each; an empty table gives no rows; other columns are ignored. One scan, no
    shuffle; the work on a text is its words times the length of the longest template at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py()) if text.is_valid else []
                base, notices = scanner.scan(words)
                starts = [s for s, _, _ in base]
                names = {label for _, _, label in base}
                rows.append(
                    {
                        "doc_id": doc,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(names)),
                        "labels": ",".join(sorted(names | {label for _, _, label in notices})),
                        "score": round(_covered(base + notices) / len(words), 9) if words else 0.0,
                        "notices": [{"start": s, "end": e, "label": label} for s, e, label in notices],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _KINDS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, _OUT)


def license_report(found: DataFrame) -> DataFrame:
    return found.drop("notices")
