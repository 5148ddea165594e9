import hashlib
import re

import pytest

from quarrygraph.llm import pii

PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERN.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return sorted(found)


ODD = [
    "a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1.2.3 10.0.0.256", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567... +12345 +1-", "\U0001f600 x@y.zz \U0001f600 10.0.0.1 é 10.10.10.10", "1" * 3000, "+1" + " " * 3000 + "2",
    "1 " * 3000, "1.2.3.4@x.y.z", "@@.@a.b a@b", "x@y.z.", "5 4111111111111111", "  ", "", "+49 30 1234567\n+49 30 1234567-", "++1 555 123 4567+1 555 123 4567",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(2 * 10**6, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.pii_report(pii.find_pii(docs)).collect()}
    for r in docs.collect():
        spans = brute(r.text or "")
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        x = got[r.doc_id]
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (r.doc_id, listed, x.spans)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))


def test_very_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000 + "@", "7" * 200_000, "1 " * 100_000, "1." * 100_000, "+1" + "-" * 200_000, "a@" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.pii_report(pii.find_pii(docs)).collect()}[0] == ""


def corpus():
    """Ten documents name Zorblat beside one address and nowhere else; the word please stands beside it too, but also
    in two hundred documents without it."""
    rows = [(i, f"some words {i} come first. please write Zorblat at z.{'orblat'}@mail.example now") for i in range(10)]
    return rows + [(100 + i, f"please read line {i} of this page") for i in range(200)]


def test_terms_that_give_a_value_away(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = pii.find_pii(docs)
    for r in found.collect():
        words = {s["value"] for s in r["terms"]}
        assert ("zorblat" in words) == (r.doc_id < 100)
        assert "please" not in words
    report = {r.doc_id: r for r in pii.pii_report(pii.find_pii(docs)).collect()}
    text = dict(corpus())[3]
    kind, a, b = next(s for s in report[3].spans.split(",") if s.startswith("term") and text[int(s.split(":")[1]) : int(s.split(":")[2])] == "Zorblat").split(":")
    assert kind == "term" and text[int(a) : int(b)] == "Zorblat"


def test_sanitised_text_and_untouched_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in corpus()] + [(None, "b@c.de", None, 1), (900, None, "y", 2), (900, None, "y", 2)], "doc_id long, text string, base string, rid long")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {(r.doc_id, r.rid): r for r in got.collect()}
    assert "[EMAIL]" in rows[3, 3].text and "orblat" not in rows[3, 3].text.lower() and "please" in rows[3, 3].text
    assert rows[105, 105].text == "please read line 5 of this page"
    assert rows[None, 1].text == "[EMAIL]" and rows[900, 2].text is None


def test_terms_far_from_the_value_and_in_few_documents(spark):
    far = "and then nothing of note " * 400
    rows = [(i, f"Zorblat's page. {far} Bo Li writes from x.y@mail.example {far} Zorblat, {'Quindle' if i == 0 else 'nobody'} and nothing") for i in range(2)]
    rows += [(100 + i, f"and then nothing of note writes from page nobody {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        text = dict(rows)[r.doc_id]
        words = [w for w in re.finditer(r"[^\W\d_]+", text) if w[0].lower() in ("zorblat", "quindle", "bo", "li")]
        assert [(s["start"], s["end"], s["value"]) for s in r["terms"] if s["value"] != "s"] == [(w.start(), w.end(), w[0].lower()) for w in words]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not re.search("Zorblat|Quindle|Bo Li", clean[0] + clean[1]) and clean[0].count("[TERM]") >= 5
    assert clean[100] == dict(rows)[100]


def test_words_inside_base_spans_count_for_nothing(spark):
    rows = [(0, "smith writes"), *[(i, "smith@corp.example writes") for i in range(1, 4)], (9, "smith@corp.example is Smith"), *[(20 + i, "is writes") for i in range(80)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s["value"] for s in r["terms"]] for r in pii.find_pii(docs).collect()}
    assert got[9] == ["smith"] and got[0] == [] and got[1] == []


@pytest.mark.parametrize("text,want", [("mail a@b.cd, ip 1.2.3.4@x.y end", "mail [EMAIL], ip [EMAIL] end"), ("1.2.3.4", "[IP]"), ("no data", "no data"), ("", "")])
def test_placeholders(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitise(docs).first().text == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_report(pii.find_pii(docs)).count() == 0
    assert pii.sanitise(docs).count() == 0


def terms_of(texts, share=pii.SHARE, bits=pii.BITS):
    """The terms of each text that give away one of its values, by counting all pairs."""
    import math
    from collections import Counter

    import regex

    values, terms, all_terms = [], [], []
    for t in texts:
        spans = brute(t)
        bare = list(t or "")
        for s in spans:
            bare[s[0] : s[2]] = " " * (s[2] - s[0])
        plain = lambda s: (t[s[0] : s[2]].lower() if s[1] < 2 else re.sub("[^0-9]", "", t[s[0] : s[2]]))
        values.append({(s[1], plain(s)) for s in spans})
        terms.append({w.lower() for w in regex.findall(r"\p{L}+", "".join(bare))})
        all_terms.append(terms[-1])
    n_term = Counter(w for x in all_terms for w in x)
    n_value = Counter(v for x in values for v in x)
    both = Counter((v, w) for x, y in zip(values, terms, strict=True) for v in x for w in y)
    tells = {k for k, n in both.items() if n / n_term[k[1]] >= share and math.log2(n * len(texts) / (n_term[k[1]] * n_value[k[0]])) >= bits}
    return [{w for w in y if any((v, w) in tells for v in x)} for x, y in zip(values, terms, strict=True)]


def test_terms_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = {r.doc_id: w for r, w in zip(rows, terms_of([r.text for r in rows]), strict=True)}
    got = {r.doc_id: {s["value"] for s in r["terms"]} for r in pii.find_pii(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 5
