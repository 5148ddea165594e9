import math

import pytest

from quarrygraph.llm import mixing


def rows_of(df, sql, tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.sql(sql).df()
    got = df.toPandas()[list(want.columns)]
    key = list(want.columns)
    return sorted(map(tuple, got[key].astype(object).values.tolist()), key=str), sorted(map(tuple, want.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("block", [16, 1024])
def test_matches_sql(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, want = rows_of(mixing.mix(docs, block_docs=block), mixing.oracle(block_docs=block), {"documents": docs.toPandas()})
    assert got == want


def test_entropy_and_repetition(spark):
    rows = [(i, "x" * 400, "big") for i in range(900)] + [(1000 + i, "x" * 400, "mid") for i in range(90)] + [(2000 + i, "x" * 400, "low") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = docs.groupBy("source").agg(mixing.F.sum(mixing.tokens_of()).alias("source_tokens"))
    x = mixing.exponent(slim, 0.9, 1000.0)
    p = [0.9**x, 0.09**x, 0.01**x]
    w = [v / sum(p) for v in p]
    assert -sum(v * math.log(v) for v in w) == pytest.approx(0.9 * math.log(3), abs=1e-5)
    x = mixing.exponent(slim, 1.0, 4.0)
    p = [0.9**x, 0.09**x, 0.01**x]
    assert p[2] / sum(p) / 0.01 == pytest.approx(4.0, abs=1e-4)
    mixed = mixing.mix(docs, 1.0, 4.0).groupBy("source").agg(mixing.F.sum(mixing.F.col("n_tokens") * mixing.F.col("n_copies")).alias("t"), mixing.F.first("weight").alias("w")).collect()
    for r in mixed:
        assert abs(r.t - r.w * 100000) <= 100


def test_nulls_repeats_names_and_empty(spark):
    schema = "doc_id long, text string, source string, block int, weight string"
    docs = spark.createDataFrame([(1, "a", None, 1, "w"), (1, "a", None, 1, "w"), (None, None, "s", None, None), (2, "b" * 99, "s", 2, "")], schema)
    assert mixing.mix(docs).count() == 4
    out = mixing.realise(docs)
    assert out.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.realise(docs.limit(0)).count() == 0
