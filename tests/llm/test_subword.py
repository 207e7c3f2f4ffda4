"""Quality by subword embeddings: features and scores by brute force, held-out
accuracy, label hygiene, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import subword as S
from weft.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def one(word):
    f, b = S.word_features(pa.array([word]))
    assert b.tolist() == [0, len(f)]
    return f


def test_features_of_a_word():
    words = ["a", "naïve", "語彙", "𝄞x", "x" * 3000]
    f, b = S.word_features(pa.array(words))
    for k, w in enumerate(words):
        mine = f[b[k]:b[k + 1]]
        assert (mine == one(w)).all()                                     # whatever stands beside it
        n = len(w) + 2
        assert len(mine) == 1 + sum(max(0, n - k + 1) for k in S.SIZES)
    assert set(one("abcd")[1:]) & set(one("xabcd")[1:]) and one("ab")[0] != one("ba")[0] != one("abab")[0]
    assert (one("abab")[1:] == one("abab")[1:]).all()
    f, b = S.word_features(pa.array([], pa.string()))
    assert len(f) == 0 and b.tolist() == [0]


def slow_probability(text, model):
    features, before = [S._COMMON], None
    for w in (text or "").split():
        features += list(one(S._AGAIN if w == before else w))
        before = w
    z = model.logits[features].astype(float).mean(axis=0) + model.bias
    return np.exp(z[1]) / np.exp(z).sum()


def test_scores_by_brute_force():
    rng = np.random.default_rng(2)
    model = S.Model(rng.normal(size=(1 << S.BITS, 2)).astype(np.float32), np.array([0.1, -0.4]))
    texts = ["some words and more words", None, "", "same same same", "same", "x y\ty\ny z", " end", "x", "x"]
    got = S.probabilities(pa.array(texts), model)
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got[:, 1], [slow_probability(t, model) for t in texts])
    assert (S.probabilities(pa.array(texts[3:5]), model)[:, 1] == got[3:5, 1]).all()


def test_gradient_is_that_of_the_loss():
    f, share = np.array([3, 9], np.int32), np.array([0.25, 0.75], np.float32)
    rows = [(1, f, share), (0, np.array([9, 11], np.int32), np.array([0.5, 0.5], np.float32))] * 60
    logits = S.fit(rows, 2, 4, 20, 2.0)
    z = [share @ logits[f] for _, f, share in rows[:2]]
    assert z[0][1] - z[0][0] > 3 and z[1][0] - z[1][1] > 3
    assert (logits[5] != 0).any() and abs(logits[3, 1]) > abs(logits[5, 1])


@pytest.fixture(scope="module")
def scored(spark):
    got = QUERIES["op13_quality"](spark, SF).toPandas()
    return got, got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")


def test_held_out_accuracy(spark, scored):
    got, m = scored
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted.astype(bool)).all()
    x = m[m.held_out]
    y, s = x.quality.to_numpy(), x.score.to_numpy()
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98 and (x.predicted == y).mean() > 0.98
    assert x.predicted[y == 1].mean() > 0.99


def rows(n):
    rng = np.random.default_rng(3)
    words = "calm soft green river stone light paper".split()
    return [(i, " ".join(rng.choice(words, 30)) + (" junk|junk" * 4 if i % 3 == 0 else ""), int(i % 3 != 0)) for i in range(n)]


def test_labels_of_held_out_rows_change_nothing(spark):
    data = rows(200)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    right = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in data], right.schema)
    a, b = S.train(docs, right), S.train(docs, wrong)
    assert (a.logits == b.logits).all()
    p = {r.doc_id: r.predicted for r in S.score(docs, a).collect()}
    assert np.mean([p[i] == y for i, _, y in data]) > 0.99


def test_odd_rows(spark):
    data = rows(120)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in data] + [(None, "calm", 9), (500, None, 9), (501, "", 9), (7, "other", 9),
                                  (502, "calm " * 50000, 9), (8, data[8][1], 9)], "doc_id long, text string, id long")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, None), (8, 5), (999, 0)], "doc_id long, quality int")
    model = S.train(docs, labels)
    out = S.score(docs, model).collect()
    assert len(out) == 126 and {r.id for r in out} == {9}
    assert len({r.score for r in out if r.doc_id in (500, 501)}) == 1 and len({r.score for r in out if r.doc_id == 8}) == 1
    with pytest.raises(ValueError):
        S.score(docs.withColumnRenamed("id", "score"), model)
    named = S.score(docs.withColumnRenamed("id", "score"), model, score_col="p", predicted_col="q")
    assert {r.score for r in named.collect()} == {9}
    assert S.score(docs.limit(0), model).count() == 0
    lone = S.train(docs, labels.filter("quality = 1"))
    assert len({r.score for r in S.score(docs, lone).collect()}) == 1
    assert not S.train(docs.limit(0), labels).logits.any()
