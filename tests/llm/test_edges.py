"""Extra columns with clashing names and very long texts, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import bpe, chat, embedding_dedup, mixing, pii, quality, simhash, suffix_dedup, token_counts, warc
from quarrygraph.llm.queries import vocabulary

NAMES = ("id", "fp", "key", "salt", "block", "base", "terms", "rid", "contexts", "word", "n", "kept", "spans", "component", "node", "a", "b", "count", "bucket", "digest", "length", "page", "filter", "many", "to", "level", "rank", "value", "turn_", "label_", "first", "kind", "epochs", "weight", "before", "reached", "rest", "copy", "salted", "row", "whole", "email", "emails", "ip", "spans", "stay", "pieces", "__email", "__emails", "__base", "__keep", "__row", "__ip", "__card", "__phone")

TEXT_OPERATORS = {
    "1": lambda d: suffix_dedup.remove_repeats(d),
    "2": lambda d: bpe.encode_digests(d, vocabulary("byte_bpe_50k.json")),
    "3": lambda d: quality.quality_rules(d, quality.KEEP_ALL),
    "6": lambda d: mixing.mix(d),
    "8": lambda d: pii.pii_report(pii.find_pii(d)),
    "9": lambda d: token_counts.token_counts(d, vocabulary("word_bpe_49k.json")),
    "10": lambda d: simhash.simhash_components(d),
}


def clashing(frame):
    return frame.withColumns({c: F.lit(c) for c in NAMES if c not in frame.columns})


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 60_000 + "a@b.cd 10.0.0.1 " + "x" * 100_000 + "\n" * 5_000 + "1234 " * 20_000
    some = [(1, "the same few words in two documents that are long enough to be found again", "s"), (2, "the same few words in two documents that are long enough to be found again", None), (3, long, "t"), (4, long, "t"), (5, None, "s"), (None, "", "s"), (5, None, "s")]
    return spark.createDataFrame(some, "doc_id long, text string, source string")


@pytest.mark.parametrize("number", list(TEXT_OPERATORS))
def test_texts(docs, number):
    run = TEXT_OPERATORS[number]
    assert rows(run(clashing(docs))) == rows(run(docs))
    assert len(rows(run(docs))) == 7


def test_other_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 2.0], 1), (2, [1.0, 0.1, 2.0], 1), (3, None, None)], "vec_id long, embedding array<float>, label int")
    assert rows(embedding_dedup.near_duplicates(clashing(vectors))) == rows(embedding_dedup.near_duplicates(vectors))
    said = spark.createDataFrame([(1, 0, "user", "a question that is long enough"), (1, 1, "bot", "> a question that is long enough\n" + "answer " * 100_000)], "conv_id long, turn long, role string, text string")
    assert rows(chat.format_chats(clashing(said))) == rows(chat.format_chats(said))
    pages = spark.createDataFrame([(1, "u", "x" * 2_000_000), (2, "v", "x" * 2_000_000)], "page_id long, url string, html string")
    get = lambda t: rows(warc.report(warc.read_archive(*warc.write_archive(t))))
    assert get(clashing(pages)) == get(pages)


def test_pipeline_stages_keep_clashing_columns(docs):
    table = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = stage(docs.sparkSession, table, "/root/testdata/sf0.001")
        assert table.columns == clashing(docs).columns, name
    assert table.count() >= 0


def test_many_spans_in_one_text(spark):
    """50,000 and 100,000 addresses in one text: linear work, and places as Python finds them."""
    import re
    import time

    def of(size):
        text = "".join(f"é{k} mail{k}@host{k % 7}.org;" for k in range(size))
        return text, spark.createDataFrame([(1, text)], "doc_id long, text string")

    seconds = []
    for size in (50_000, 50_000, 100_000):  # the first run warms up
        text, docs = of(size)
        start = time.time()
        base = pii.with_base_spans(docs).first().base
        seconds.append(time.time() - start)
    assert seconds[2] < 2.3 * seconds[1] + 1
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s.start, s.end) for s in base if s.kind == 0] == emails
    clean = pii.sanitise(of(50_000)[1]).first().text
    assert "@" not in clean and clean.count("[EMAIL]") == 50_000


def test_dotted_column_names(docs):
    from pyspark.sql import functions as F

    table = docs.withColumn("a.b", F.lit(1))
    assert mixing.realise(table).columns == table.columns
    assert pii.sanitise(table).columns == table.columns
    assert simhash.keep_one(table).columns == table.columns


def test_unfinished_components_are_an_error(spark):
    import pytest

    from quarrygraph.llm.common import connected_components

    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="still changing"):
        connected_components(path, max_rounds=1)
    assert {r.component for r in connected_components(path).collect()} == {0}
