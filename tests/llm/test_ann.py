"""Approximate nearest neighbours against brute force."""

import numpy as np
import pytest

from weft.llm import ann
from weft.llm.queries import QUERIES


def brute(rows, top, is_query):
    """{query id: [(id, score)]} over all others, ties to the smaller id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for k, q in enumerate(ids):
        if is_query(q):
            s = (x * x[k]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
            out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def collected(df, id_col="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r[id_col], r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = collected(QUERIES["op9_nearest"](spark, sf))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    exact = {i: dict(v) for i, v in want.items()}
    recall = np.mean([len({i for i, _ in got[q]} & set(exact[q])) / 20 for q in want])
    assert recall >= 0.95
    x = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - np.dot(np.array(x[q], np.float64), np.array(x[i], np.float64))) < 1e-12
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_ties_hot_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8).round(3).tolist()
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)] + [(1000 + i, hot) for i in range(400)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None] + [1.0] * 6), (5020, [float("nan")] * 8), (5040, [float("inf")] + [1.0] * 7),
           (5060, [1.0, 2.0]), (5080, []), (None, hot), (20, rows[20][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, score string").repartition(4)
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = collected(ann.nearest(df, lambda i: i % 20 == 0, query_ratio=9.0))       # every list: exact
    assert got == want
    got = collected(ann.nearest(df, lambda i: i % 20 == 0, query_ratio=9.0, part_rows=20, shard_bytes=1 << 12, list_size=10))
    assert got == want
    got = collected(ann.nearest(df, lambda i: i % 20 == 0, list_size=20))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())


def test_ids_with_several_vectors(spark):
    """Each row is a candidate: an id has the score of its best pair of vectors."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.9]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert collected(ann.nearest(df, lambda i: i % 20 == 0)) == {0: [(1, 0.9), (2, 0.5)]}
    rng = np.random.default_rng(9)
    ids = [*range(200), *[7] * 300, *[40] * 5, *[33] * 30]                # 7: a hot id; 40: a query of six vectors
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in ids]
    best = {}
    for q, v in rows:
        if q % 20 == 0:
            for i, u in rows:
                if i != q:
                    best[q, i] = max(best.get((q, i), -np.inf), (np.array(u) * np.array(v)).sum())
    want = {q: sorted(((i, s) for (p, i), s in best.items() if p == q), key=lambda r: (-r[1], r[0]))[:20] for q in range(0, 200, 20)}
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>").repartition(4)
    assert collected(ann.nearest(df, lambda i: i % 20 == 0, query_ratio=9.0)) == want
    assert collected(ann.nearest(df, lambda i: i % 20 == 0, query_ratio=9.0, part_rows=20, shard_bytes=1 << 12, list_size=10)) == want


def test_largest_product_not_least_distance(spark):
    """Norms differ: the largest product wins."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.1, 5)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = collected(ann.nearest(df, lambda i: i % 20 == 0))
    assert np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 20 for q in want]) >= 0.9


def test_tiny_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert collected(ann.nearest(df, lambda i: i % 20 == 0)) == {0: [(1, 0.5), (40, -1.0)], 40: [(1, -0.5), (0, -1.0)]}
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(df.limit(1), lambda i: i % 20 == 0).count() == 0


def test_walk_finds_what_it_should():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12))
    m = float(np.sqrt((x * x).sum(1)).max())
    index = ann.fit(x, m, 60)
    q = ann.as_queries(x[:200], m)
    d, near = index.walk(q, 1.1)
    exact = np.sqrt(((q[:, None, :] - index.c[None]) ** 2).sum(-1))
    met = np.isfinite(d)
    assert np.allclose(d[met], exact[met])
    truth = exact <= exact.min(1, keepdims=True) * 1.1
    assert (near & truth).sum() >= 0.98 * truth.sum()
    one = ann.fit(x[:3], m, 1)
    assert one.walk(q, 1.1)[1].all()
