"""Personal data: exact base patterns and information-theoretic sanitisation of the terms around them.

Everything is DataFrame expressions. The patterns below accept exactly what the base patterns accept, leftmost and
non-overlapping, but with possessive quantifiers and look-behinds, so that long runs of digits or letters take linear
time and no deep recursion. Offsets come from the lengths of what ``split`` leaves between matches.

Disclosure: for a protected value e and a term t anywhere in a document that mentions it, over all documents,
P(e | t) = n(t, e) / n(t) and the pointwise mutual information log2(n(t, e) * N / (n(t) * n(e))). A term whose two
figures reach the thresholds gives e away, and all its occurrences in documents that mention e are spans of kind
``term``. Terms are whole words of letters outside the base spans.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound, scan, write_shared

#: Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Production parameters: the two thresholds.
SHARE, BITS = 0.5, 3.0

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _valid_span(kind: str, s: Column) -> Column:
    return _valid(kind, s["value"])


def _numbered(k: int, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))


def _of_kind(k: int, s: Column) -> Column:
    return s["kind"] == k


def _located(found: Column, between: Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches from the matches and the pieces between them."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["1"])
        end = start + F.length(x["0"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["0"].alias("value"))

    pairs = F.arrays_zip(found.alias("0"), F.slice(between, F.lit(1), F.size(found)).alias("1"))
    return scan(pairs, F.lit(0), step, "int", "struct<start:int,end:int,value:string>")


def _base_spans(rows: DataFrame) -> DataFrame:
    """``rows(row, whole, ...)`` with ``base``: the valid base spans of ``whole``, by start and kind."""
    whole = F.col("whole")
    hint = {"email": F.contains(whole, F.lit("@")), "phone": F.contains(whole, F.lit("+"))}
    none = F.expr("cast(array() as array<string>)")
    kept = rows.columns
    for kind in KINDS:
        found = F.regexp_extract_all(whole, F.lit(PATTERNS[kind]), F.lit(0))
        rows = rows.withColumn(kind, F.when(hint[kind], found).otherwise(none) if kind in hint else found)
    for kind in KINDS:
        rows = rows.withColumn(f"{kind}s", F.when(F.size(kind) > 0, F.split(whole, PATTERNS[kind], -1)).otherwise(none))
    parts = []
    for k, kind in enumerate(KINDS):
        spans = F.filter(_located(F.col(kind), F.col(f"{kind}s")), partial(_valid_span, kind))
        parts.append(F.transform(spans, partial(_numbered, k)))
    any_ = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    base = F.when(any_, F.array_sort(F.concat(*parts))).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    return rows.select(*kept, base.alias("base"))


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """``docs`` with ``out``: the valid base spans ``struct(start, kind number, end, value)`` of the whole text, by
    start and kind; a null text has none. The other columns are kept, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    return _base_spans(rows).select("row.*", F.col("base").alias(out))


#: Code points of a piece of a text that is looked into at many places.
PIECE = 2048


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end``, found without passing all that come before them."""
    first = F.floor(start / PIECE).cast("int")
    last = F.greatest(first, F.floor(end / PIECE).cast("int"))
    near = F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(pieces, k)), "")
    return F.substr(near, start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def _entity(span: Column) -> Column:
    """One key for all spellings of a protected value."""
    plain = F.when(span["kind"].isin(2, 3), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def _bare(text: Column, base: Column) -> Column:
    """The text with a blank for each code point inside a base span, so that places stay."""

    def over(pieces: Column) -> Column:
        def step(at: Column, span: Column) -> tuple[Column, Column]:
            start, end = F.greatest(span["start"], at), F.greatest(span["end"], at)
            return end, F.concat(_part(pieces, at, start), F.repeat(F.lit(" "), end - start))

        return F.array_join(scan(F.concat(base, F.array(_end(text, -1))), F.lit(0), step, "int", "string"), "")

    return bound(_pieces(text), over)


def _end(text: Column, kind: int) -> Column:
    """An empty span at the end of a text."""
    size = F.length(text)
    return F.struct(size.alias("start"), F.lit(kind).alias("kind"), size.alias("end"), F.lit("").alias("value"))


def _places(near: DataFrame) -> DataFrame:
    """``(rid, term, start, end)`` of all words of letters, lower-cased, in the texts of ``near(rid, bare)``. A window
    sums the lengths of one text's pieces; an array folded word by word would be copied for each."""
    pieces = near.select("rid", F.posexplode(F.split("bare", r"\P{L}", -1)).alias("pos", "word"))
    until = F.sum(F.length("word") + 1).over(Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumn("end", (until - 1).cast("int")).where("word <> ''")
    return placed.select("rid", F.lower("word").alias("term"), (F.col("end") - F.length("word")).cast("int").alias("start"), "end")


def _vocabulary(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.filter(F.split(text, r"\P{L}+"), lambda w: w != "")), F.lower))


def _in_documents(held: DataFrame, name: str) -> DataFrame:
    """Of ``held(rid, name)``, whose rows are distinct: each ``name``, the number of its documents as ``m``, and two
    hashes of the set of them. Hashes are combined before the shuffle, so a value that is in a third of all documents is
    a few rows."""
    hashes = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    return held.groupBy(name).agg(F.count("*").alias("m"), *hashes)


def disclosed(docs: DataFrame, found: DataFrame, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """``(rid, term)`` of the terms that give away a protected value of their document. ``found(rid, entities, terms,
    hidden)`` has a row for each document with base spans: its distinct values, its distinct terms outside the spans,
    and those that it has inside them only. Counts are numbers of documents, over all of ``docs``.

    Values that are in the same documents have the same figures with any term, so they are one class, and so are
    terms; only classes are paired, not the values and terms of a document. A term that more than 1 / ``share`` times
    as many documents have as name any value is out before that: its share can't be reached.
    """
    value = found.select("rid", F.explode("entities").alias("entity"))
    spoken = found.select("rid", F.explode("terms").alias("term"))
    words = docs.select(F.explode(_vocabulary(F.coalesce("text", F.lit("")))).alias("term"), F.lit(1).alias("k"))
    words = words.unionByName(found.select(F.explode("hidden").alias("term"), F.lit(-1).alias("k")))
    everywhere = words.groupBy("term").agg(F.sum("k").alias("n_term"))
    term = _in_documents(spoken, "term").join(everywhere, "term").where(F.col("m") >= share * F.col("n_term"))
    values = value.join(_in_documents(value, "entity"), "entity").groupBy("rid").agg(F.collect_set(F.struct(F.col("m").alias("n_entity"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))).alias("values"))
    placed = write_shared(spoken.join(term, "term").select("rid", "term", "n_term", "h1", "h2"), "pii-terms")
    classes = placed.select("rid", "n_term", "h1", "h2").distinct()
    pairs = classes.join(values, "rid").select("rid", "n_term", "h1", "h2", F.explode(F.filter("values", lambda v: v["n_entity"] >= share * F.col("n_term"))).alias("v"))
    pairs = write_shared(pairs.select("rid", "n_term", "h1", "h2", "v.*"), "pii-pairs")
    total = docs.agg(F.count("*").alias("n"))
    scored = pairs.groupBy("n_term", "h1", "h2", "n_entity", "e1", "e2").agg(F.count("*").alias("n_both")).crossJoin(F.broadcast(total))  # one row
    telling = scored.where((F.col("n_both") / F.col("n_term") >= share) & (F.log2(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_entity"))) >= bits))
    keys = ["n_term", "h1", "h2"]
    hits = pairs.join(telling.select(*keys, "e1", "e2"), [*keys, "e1", "e2"], "left_semi").select("rid", *keys).distinct()
    return placed.join(hits, ["rid", *keys], "left_semi").select("rid", "term")


def _search(docs: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """``found(rid, row, doc_id, base)``, a row for each of ``docs``, and ``terms(rid, terms)`` of those that have any.
    ``row`` has the columns of ``docs`` with ``keep``, else none. Texts are searched once."""
    columns = [F.col(f"`{c}`") for c in docs.columns] if keep else [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("whole"))
    rows = _base_spans(rows)
    some = F.size("base") > 0
    bare = F.when(some, _bare(F.col("whole"), F.col("base")))
    rows = rows.select("row", "doc_id", "base", bare.alias("bare"), F.when(some, _vocabulary(F.col("whole"))).alias("raw"))
    found = write_shared(rows.withColumn("rid", F.monotonically_increasing_id()), "pii")
    entities = F.array_distinct(F.transform("base", _entity))
    near = found.where(some).select("rid", entities.alias("entities"), _vocabulary(F.col("bare")).alias("terms"), "raw", "bare")
    counted = near.select("rid", "entities", "terms", F.array_except("raw", "terms").alias("hidden"))
    hits = disclosed(docs, counted)
    places = _places(near).join(hits, ["rid", "term"])
    spans = places.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", F.col("term").alias("value")))).alias("terms"))
    return found.drop("bare", "raw"), spans


def _with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    return found.join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", F.expr(f"cast(array() as {_SPAN})")))


def find_pii(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, base, terms)`` of every row of ``docs(doc_id, text)``: ``base`` as by :func:`with_base_spans`,
    ``terms`` the disclosing terms' ``struct(start, kind = 4, end, value)``; ``rid`` numbers the rows.

    A null text has no spans; a null doc_id stays null; repeated rows are counted and returned each; an empty table
    gives no rows; other columns are left alone.
    """
    found, terms = _search(docs, keep=False)
    return _with_terms(found.drop("row"), terms)


NAMES = (*KINDS, "term")


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` from :func:`find_pii`."""
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind's placeholder; a span inside an earlier one is part of it."""
    label = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES], F.lit(""))

    def over(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            put = F.concat(_part(pieces, at, s["start"]), F.get(label, s["kind"]))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.lit("")).otherwise(put)

        return F.array_join(scan(F.concat(spans, F.array(_end(text, len(NAMES)))), F.lit(0), step, "int", "string"), "")

    return bound(_pieces(text), over)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, whatever their names, personal data and disclosing terms generalised to
    placeholders. Texts are searched once, and rows without base spans move nowhere. A null text stays null, repeated
    rows stay each, and an empty table gives no rows."""
    found, terms = _search(docs, keep=True)
    clean = found.where(F.size("base") == 0).select("row.*")
    dirty = _with_terms(found.where(F.size("base") > 0), terms).select("row", F.array_sort(F.concat("base", "terms")).alias("spans"), F.col("row.text").alias("text"))
    dirty = dirty.select("row", _replaced(F.col("text"), F.col("spans")).alias("text"))
    return clean.unionByName(dirty.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
