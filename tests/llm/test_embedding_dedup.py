import numpy as np
import pytest

from quarrygraph.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """Links, components and kept flags by comparing all pairs."""
    ok = [i is not None and e is not None and label is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e) for i, e, label in rows]
    n = len(rows)
    links, label_of = [0] * n, list(range(n))

    def find(x):
        while label_of[x] != x:
            x = label_of[x]
        return x

    unit = [np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) if good else None for (_, e, _), good in zip(rows, ok, strict=True)]
    groups = {}
    for k, good in enumerate(ok):
        if good:
            groups.setdefault((rows[k][2], len(unit[k])), []).append(k)
    for members in groups.values():
        x = np.stack([unit[k] for k in members])
        for a, row in enumerate(x @ x.T >= cosine):
            for b in np.flatnonzero(row):
                if a != b:
                    links[members[a]] += 1
                    p, q = find(members[a]), find(members[b])
                    label_of[max(p, q)] = min(p, q)
    low = {}
    for k in range(n):
        if rows[k][0] is not None:
            low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((i, links[k], low.get(find(k)), i == low.get(find(k)) or i is None) for k, (i, _, _) in enumerate(rows)), key=str)


def found(frame, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, **options).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_matches_brute_force(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert found(frame) == brute([tuple(r) for r in frame.collect()])


def test_large_tight_groups_in_tiles_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(4):
        centre = rng.standard_normal(16)
        for _ in range(120):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), g % 2))
    some = rows[0][1]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] + some[1:], 0), (1004, [float("inf")] + some[1:], 0), (1005, [None, *some[1:]], 0), (1006, some, None), (1007, some, 0), (1007, some, 0), (1008, [v * 1e30 for v in some], 0), (1009, some[:9], 0), (None, some, 0), (1010, [1.0], 0), (1011, [2.0], 0), (1012, [-2.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(frame, tile=20) == brute(rows)
    assert found(frame) == brute(rows)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_linking_cosine():
    rng = np.random.default_rng(2)
    for vectors in (500, 5_000, 50_000):
        code = embedding_dedup.Code.of(vectors)
        x = rng.standard_normal((2000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        r = rng.standard_normal((2000, 64))
        r -= (r * x).sum(1, keepdims=True) * x
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * r
        pairs = zip(embedding_dedup.filters(x, code), embedding_dedup.filters(y, code), strict=True)
        assert np.mean([len(np.intersect1d(a, b)) == 0 for a, b in pairs]) < 0.01


@pytest.mark.parametrize("vectors", [50_000, 1_000_000, 4_000_000, 16_000_000])
def test_common_filters_and_recall_hold_on_large_tables(vectors):
    rng = np.random.default_rng(3)
    code = embedding_dedup.Code.of(vectors)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((500, 64))
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * r
    pairs = zip(embedding_dedup.filters(x, code), embedding_dedup.filters(y, code), strict=True)
    common = np.array([len(np.intersect1d(a, b)) for a, b in pairs])
    assert abs(common.mean() - embedding_dedup.EXPECTED * embedding_dedup.CODES) < 6
    assert np.mean(common == 0) < 0.01


@pytest.mark.parametrize("dim", [3, 16, 32, 48])
@pytest.mark.parametrize("vectors", [50_000, 1_000_000])
def test_short_vectors_pass_filters_too(dim, vectors):
    rng = np.random.default_rng(4)
    code = embedding_dedup.Code.of(vectors)
    assert embedding_dedup.threshold(embedding_dedup.fitted(code, dim), dim) <= embedding_dedup.MOST_LIMIT
    x = embedding_dedup._units(rng.standard_normal((500, dim)))
    r = rng.standard_normal((500, dim))
    r = embedding_dedup._units(r - (r * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * r
    a, b = embedding_dedup.filters(x, code), embedding_dedup.filters(y, code)
    assert np.mean([len(np.intersect1d(u, v)) == 0 for u, v in zip(a, b, strict=True)]) < 0.01
    assert len(np.unique(np.concatenate(a))) > 100 or dim == 3  # and not all pass the same
