"""Toxicity: features by brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import toxicity as T
from weft.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def slow_grams(text):
    raw = bytes(max(b, 32) for b in text.lower().encode())
    return {(n, raw[i:i + n]) for n in T.SIZES for i in range(len(raw) - n + 1)}


def test_features_are_the_distinct_grams():
    texts = ["Abcdef abcdef", "", None, "x", "é\n\té word", "again again again"]
    doc, f = T.distinct_features(pa.array(texts))
    one, g = T.distinct_features(pa.array(["abcdef abcdef"]))
    assert (f[doc == 0] == g).all()
    for i, t in enumerate(texts):
        want = slow_grams(t or "")
        assert len(set(f[doc == i])) == (doc == i).sum() <= len(want)
        assert (doc == i).sum() >= len(want) - 1          # hash collisions apart
    keep = np.zeros(1 << T.BITS, bool)
    keep[g[:2]] = True
    assert set(T.distinct_features(pa.array(texts), keep)[1]) <= set(g[:2])


@pytest.fixture(scope="module")
def scored(spark):
    got = QUERIES["op7_toxicity"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return got, got.merge(labels, on="doc_id")


def test_held_out_accuracy(scored):
    got, m = scored
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted.astype(bool)).all()
    x = m[m.held_out]
    y, s = x.toxic.to_numpy(), x.score.to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.97 and (x.predicted == y).mean() > 0.96
    assert x.predicted[y == 1].mean() > 0.75 and x.predicted[y == 0].mean() < 0.01


def rows(n):
    bad, words = ["dreadful", "nasty"], "calm soft green river stone light paper".split()
    rng = np.random.default_rng(3)
    return [(i, " ".join(rng.choice(words, 30)) + (" " + bad[i % 2] if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(n)]


def test_odd_rows(spark):
    data = rows(300)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in data] + [(None, "calm", None), (500, None, "s"), (501, "", "s"), (7, data[7][1], "s"),
                                  (502, "green stone " * 50_000 + "nasty", "s")], "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(1, 1), (1, None), (9999, 1), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "text", "source", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].predicted == y for i, _, y in data if i != 1)
    assert got[500].score == got[501].score and got[502].predicted == 1
    assert T.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_used(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in data]
    a = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    b = T.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (a.weights == b.weights).all() and a.bias == b.bias


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a text"), (2, "another")], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not model.weights.any() and len({r.score for r in T.score(docs, model).collect()}) == 1


def test_no_table_of_all_features_comes_to_the_driver(spark, monkeypatch):
    """Fixed tables of 2^BITS counts, some for each task, filled the driver."""
    from pyspark.sql.classic.dataframe import DataFrame
    got = []

    def watched(f):
        def g(self, *a):
            out = f(self, *a)
            got.extend(r for r in (out if isinstance(out, list) else [out]))
            return out
        return g
    for name in ("collect", "head", "first"):
        monkeypatch.setattr(DataFrame, name, watched(getattr(DataFrame, name)))
    data = rows(300)
    model = T.train(spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"),
                    spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    assert model.weights.any() and got
    assert max(len(v) for r in got for x in (r if isinstance(r, list) else [r]) for v in x if isinstance(v, (bytes, bytearray))) < 1 << T.BITS
