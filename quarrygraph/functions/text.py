"""Scalar functions of the engine as Column expressions; no Python code runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "the", "a", "an", "of", "to", "in", "is", "are", "how", "does", "do", "what",
    "where", "which", "that", "this", "it", "for", "on", "and", "or", "with",
    "i", "we", "get", "set", "use", "used", "using", "when", "why", "can",
)
#: Fixed values of BM25 and of the ranking.
K1, B = 1.2, 0.75
NAME_WEIGHT, PATH_WEIGHT, GRAPH_WEIGHT, RESCUE_FLOOR, TEST_PENALTY = 3, 2, 0.5, 0.15, 0.35
#: Fixed pattern of test paths in ranking.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec)/|(_test|\.test|\.spec)\.[a-z]+$|(^|/)(test_[^/]+|conftest)\.py$"


def raw_tokens(text: Column) -> Column:
    """Lower-case pieces: camel case is split, then everything that isn't a letter a-z or a digit."""
    return F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")


def is_token(piece: Column) -> Column:
    return (F.length(piece) > 1) & ~piece.isin(*STOP_WORDS)


def only_tokens(pieces: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(pieces, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def tokenize(text: Column) -> Column:
    """Pieces of more than one character that aren't stop words."""
    return only_tokens(raw_tokens(text))


def idf(docs: Column, df: Column) -> Column:
    return F.log1p(docs / (1 + df))


def bm25(tf: Column, idf_: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    norm = k1 * (1 - b + b * length / F.when(average == 0, 1.0).otherwise(average))
    return idf_ * (tf * (k1 + 1)) / (tf + norm)


def has_term(tokens: Column, term: Column) -> Column:
    """Presence of a term or of its plural or singular form."""
    shorter = F.substr(term, F.lit(1), F.greatest(F.length(term) - 1, F.lit(0)))
    return F.array_contains(tokens, term) | F.array_contains(tokens, F.concat(term, F.lit("s"))) | (term.endswith("s") & F.array_contains(tokens, shorter))


def path_under(path: Column, prefix: Column) -> Column:
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def is_test_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_PATH)


def test_factor(path: Column, query_wants_tests: bool = False) -> Column:
    return F.lit(1.0) if query_wants_tests else F.when(is_test_path(path), F.lit(TEST_PENALTY)).otherwise(F.lit(1.0))


def decay(age_days: Column, half_life_days: float = 120.0) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life_days)


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x <= 0) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), x))


def normalize_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def slugify(x: Column) -> Column:
    """Lower-case words joined by hyphens; 'node' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("node"))


def posix_path(x: Column) -> Column:
    """Forward slashes, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+", "/"), "(.)/$", "$1")


def dir_key(path: Column, depth: int) -> Column:
    return F.substring_index(path, "/", depth)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def strip_ordinals(x: Column) -> Column:
    return F.regexp_replace(x, r"~[0-9]+(\.|$)", "$1")


def owner_of_method(node_id: Column) -> Column:
    """The last but one dotted part behind the hash, null where there is none."""
    parts = F.split(F.regexp_extract(node_id, "#(.*)$", 1), r"\.")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))


def search_body(x: Column, cap: int = 5000) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, cap)


def to_tokens(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("bigint")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def slice_span(text: Column, start: Column, end: Column, cap: int = 80, path: Column | None = None) -> Column:
    """Lines ``start`` to ``end`` as far as there are any; beyond ``cap`` of them a line says how many more."""
    lines = F.split(text, "\n")
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    n = F.greatest(last - first + 1, F.lit(0))
    kept = F.array_join(F.slice(lines, first, F.least(n, F.lit(cap))), "\n")
    place = F.concat(F.coalesce(path, F.lit("")) if path is not None else F.lit(""), F.lit(":L"), first.cast("string"), F.lit("-L"), last.cast("string"))
    more = F.concat(F.lit("\n… (+"), (n - cap).cast("string"), F.lit(" more lines; open "), place, F.lit(")"))
    return F.when(n > cap, F.concat(kept, more)).otherwise(kept)


def first_prose(body: Column) -> Column:
    """First line that isn't blank, a heading, a comment or a list item, stripped; '' where there is none."""
    lines = F.filter(F.transform(F.split(body, "\n"), _stripped), lambda x: (x != "") & ~x.rlike("^(#|<!--|-)"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def humanize_test_name(x: Column) -> Column:
    """A test's name as words; null below three words. Only a name of nothing but letters is split at its capitals."""
    bare = F.regexp_replace(x, r"(?i)^(test|it|should|describe)[_\s]*", "")
    camel = bare.rlike("^[A-Za-z]+$") & bare.rlike("[a-z][A-Z]")
    spaced = F.when(camel, F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2")).otherwise(bare)
    words = _stripped(F.regexp_replace(spaced, r"[_\-\s]+", " "))
    return F.when(F.size(F.split(words, " ")) >= 3, F.lower(words))


#: Fixed value: what a word of a question is made of.
SUBJECT_WORD = r"[\p{L}\p{N}_.$:@#/~\\()-]+"


def subject_words(query: Column) -> Column:
    """Distinct words, each that ends in ``()`` also without, longest first, then in order of the alphabet."""
    words = F.regexp_extract_all(query, F.lit(SUBJECT_WORD), F.lit(0))
    both = F.flatten(F.transform(words, lambda w: F.when(F.endswith(w, F.lit("()")), F.array(w, F.substr(w, F.lit(1), F.length(w) - 2))).otherwise(F.array(w))))
    keyed = F.array_sort(F.transform(F.array_distinct(both), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(keyed, lambda s: s["w"])


#: The family of each relation, all others being associations, and the verb that a vague one stands for.
FAMILIES = {
    "part_of": "structure", "contains": "structure",
    "uses": "dependency", "depends_on": "dependency", "calls": "dependency", "imports": "dependency",
    "produces": "dependency", "configures": "dependency", "validates": "dependency",
    "extends": "contract", "implements": "contract",
    "references": "association",
}
VERBS = {"influences": "configures", "supports": "validates", "defines": "validates", "measures": "validates"}


def _lookup(table: dict[str, str], x: Column, other: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(known, x), other)


def relation_family(relation: Column) -> Column:
    return _lookup(FAMILIES, relation, F.lit("association"))


def normalize_relation(relation: Column) -> Column:
    return _lookup(VERBS, relation, relation)


def _bucket(x: Column, first: str, steps: list[tuple[float, str]], last: str) -> Column:
    out = F.when(x <= 0, first) if first else None
    for below, label in steps:
        out = F.when(x < below, label) if out is None else out.when(x < below, label)
    return out.otherwise(last)


#: Fixed labels and limits of the report's buckets.
def files_bucket(n: Column) -> Column:
    return _bucket(n, "0", [(50, "1-49"), (200, "50-199"), (1000, "200-999"), (5000, "1000-4999")], "5000+")


def duration_bucket(ms: Column) -> Column:
    return _bucket(ms / 1000, "", [(1, "<1s"), (5, "1-5s"), (30, "5-30s"), (120, "30s-2m"), (600, "2-10m")], "10m+")


def count_bucket(n: Column) -> Column:
    return _bucket(n, "0", [(5, "1-4"), (20, "5-19"), (50, "20-49"), (200, "50-199")], "200+")


def saved_tokens_bucket(n: Column) -> Column:
    return _bucket(n, "0", [(1000, "<1k"), (5000, "1-5k"), (20000, "5-20k"), (100000, "20-100k")], "100k+")


def langs_value(langs: Column) -> Column:
    clean = F.filter(F.transform(langs, lambda x: F.trim(F.lower(x))), lambda x: F.length(x).between(1, 24) & x.rlike("^[a-z0-9+#._-]+$"))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(clean)), 1, 8), ",")


def github_handle(email: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(email), r"(?i)^(?:[0-9]+\+)?([a-z0-9](?:-?[a-z0-9]){0,38})@users\.noreply\.github\.com$", 1), F.lit(""))


def is_bot(name: Column, email: Column) -> Column:
    return name.rlike(r"(?i)\[bot\]") | email.rlike(r"(?i)\[bot\]@") | F.trim(name).rlike(r"(?i)^(github-actions|dependabot|renovate)(\[bot\])?$")


def span_bounds(span: Column) -> tuple[Column, Column]:
    """Start and end of ``L<start>-L<end>``; null for anything else."""
    return tuple(F.nullif(F.regexp_extract(span, r"^L([0-9]+)-L([0-9]+)$", k), F.lit("")).cast("int") for k in (1, 2))


def number_with_suffix(x: Column) -> Column:
    """``12.5k`` and ``3m`` as numbers; null without a number."""
    n = F.nullif(F.regexp_extract(x, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([km]?)", 1), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(x, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([km]?)", 2))
    return n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)


def reference_line(text: Column, name: str, start: Column, end: Column) -> Column:
    """First line of the span that holds ``name`` as a word, trimmed; null where none does."""
    from re import escape

    lines = F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0)))
    return F.trim(F.try_element_at(F.filter(lines, lambda x: x.rlike(rf"\b{escape(name)}\b")), F.lit(1)))


#: Fixed value: where a long label may be cut.
CLAUSE_BREAK = r"\s(?:\(|—|-\s)|:\s|\s(?:via|and|for|with|using|in|across|over|from|of|by|to)\s"


def short_label(x: Column, cap: int = 30) -> Column:
    """A label of ``cap`` characters or a few less, without a leading ``concept:``: cut at its first clause break
    where that leaves eight or more, else at the last blank of the second half, with an ellipsis."""
    bare = _stripped(F.regexp_replace(x, r"(?i)^concepts?:\s*", ""))
    clause = F.regexp_extract(bare, f"(?is)^(.*?)(?:{CLAUSE_BREAK})", 1)
    head = F.substring(bare, 1, cap + 1)
    blank = F.instr(F.reverse(head), " ")
    at = F.when(blank > 0, F.length(head) - blank).otherwise(-1)
    cut = F.substr(bare, F.lit(1), F.when(at > cap / 2, at).otherwise(cap))
    trimmed = lambda c: F.regexp_replace(c, r"\s+$", "")
    return F.when(F.length(bare) <= cap, bare).when(F.length(clause).between(8, cap), trimmed(clause)).otherwise(F.concat(trimmed(cut), F.lit("…")))


def since_label(days: Column) -> Column:
    """How long ago, in whole days rounded: today, yesterday, then days, months and years."""
    d = F.greatest(F.floor(days + 0.5), F.lit(0)).cast("bigint")
    months, years = F.floor(d / 30 + 0.5).cast("string"), F.floor(d / 365 + 0.5).cast("string")
    return F.when(d < 1, "today").when(d == 1, "yesterday").when(d < 31, F.concat(d.cast("string"), F.lit("d ago"))).when(F.floor(d / 30 + 0.5) < 24, F.concat(months, F.lit("mo ago"))).otherwise(F.concat(years, F.lit("y ago")))


def format_dollars(usd: Column) -> Column:
    """Two decimals; what is less than a cent is never shown as nothing."""
    return F.when(usd < 0.01, "<$0.01").when(usd.isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", usd.cast("double"))))


def version_key(version: Column) -> Column:
    """The release part of a dotted version as numbers without zeros at the end; such arrays order as versions do."""
    parts = F.transform(F.split(F.substring_index(version, "-", 1), r"\."), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.filter(parts, lambda x, k: F.exists(F.slice(parts, k + 1, F.size(parts)), lambda y: y != 0))


def is_newer(candidate: Column, current: Column) -> Column:
    return F.coalesce((candidate != "") & (version_key(candidate) > version_key(current)), F.lit(False))


def exported(language: Column, name: Column, head: Column) -> Column:
    """Whether a definition can be seen from outside, by its language's own rule: ``head`` is the text of its
    declaration. Languages without a rule show everything."""
    before = F.regexp_extract(head, r"^((?:[\w@]+(?:\([^)]*\))?\s+)*)", 1)  # modifiers and keywords in front of the name
    has = lambda *words: before.rlike(r"(^|\s)(" + "|".join(words) + r")(\s|$)")
    own = F.substring(F.substring_index(name, ".", -1), 1, 1)
    return F.coalesce(
        F.when(language == "go", (own != F.lower(own)) & (own == F.upper(own)))
        .when(language == "java", has("public", "protected"))
        .when(language == "kotlin", ~has("private", "internal", "protected"))
        .when(language == "swift", ~has("private", "fileprivate"))
        .when(language == "php", ~has("private", "protected"))
        .when(language.isin("typescript", "javascript", "vue"), has("export"))
        .when(language == "r", ~name.startswith("."))
        .when(language == "python", ~F.substring_index(name, ".", -1).startswith("_"))
        .when(language == "rust", head.rlike(r"^pub\b")),
        F.lit(True),
    )
