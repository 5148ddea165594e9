import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from quarrygraph.llm import mixing, quality
from quarrygraph.llm.queries import vocabulary

from .test_pii import brute as pii_spans
from .test_simhash import brute_print, components


def test_stages_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    staged, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        staged = stage(spark, staged, sf).cache()
        counts[name] = staged
        if name != "bpe_encode":
            assert staged.columns == docs.columns
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.quality_rules(docs, model).where("kept").collect()}
    assert {r.doc_id for r in counts["quality_rules"].collect()} == good
    ids = sorted(good)
    label = components(ids, [brute_print(rows[i].text) for i in ids])
    single = {i for i in ids if label[i] == i}
    assert sorted(r.doc_id for r in counts["simhash_near_dedup"].collect()) == sorted(single)
    clean = {r.doc_id: r.text for r in counts["personal_data"].collect()}
    assert set(clean) == single
    for i in single:
        if not pii_spans(rows[i].text):
            assert clean[i] == rows[i].text
        else:
            assert not pii_spans(clean[i]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", clean[i])
    mixed = Counter(r.doc_id for r in counts["mix_sources"].collect())
    want = {r.doc_id: r.n_copies for r in mixing.mix(counts["personal_data"]).collect() if r.n_copies}
    assert mixed == want
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in counts["bpe_encode"].collect():
        assert list(r.ids) == tok.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip
    assert Counter(r.doc_id for r in counts["bpe_encode"].collect()) == want
    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.n_tokens) for r in run.collect()) == Counter((r.doc_id, r.n_tokens) for r in counts["bpe_encode"].collect())


def test_stages_take_nulls_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None)] * 2 + [(10**6, "", None, "s", 0)], docs.schema))
    for table in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf).count()
