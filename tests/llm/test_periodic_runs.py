"""Periodic runs: grammar extensions and runs by brute force, the query against
a restatement of its rule, odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import periodic_runs as R
from weft.llm.queries import QUERIES
from weft.llm.words import split

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, least=12):
    """Stretches where the word p later is the same, less those of a smaller period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def slow_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


words = st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcdefgh"), max_size=80)
texts = st.lists(st.tuples(words, st.integers(1, 4)).map(lambda x: x[0] * x[1]), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_runs_by_brute_force(docs):
    w = split(pa.array([" ".join(d) for d in docs]))
    got = [[] for _ in docs]
    for t, s, n, p in zip(*R.find_runs(w.codes, w.offsets)):
        got[t].append((s, n, p))
    assert got == [slow_runs(d) for d in docs]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=120), st.integers(1, 3))
def test_extensions_by_brute_force(body, times):
    s = np.array([90, *body * times, 91])
    n = len(s)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, n - 1), np.arange(1, n - 1)))
    i, j = i[i < j], j[i < j]
    g = R.Grammar(s)
    assert len(g.rounds) <= 12 * np.log2(n) + 40

    def slow(a, b, step):
        k = 0
        while s[a] == s[b]:
            a, b, k = a + step, b + step, k + 1
        return k
    assert g.extend(i, j).tolist() == [slow(a, b, 1) for a, b in zip(i, j)]
    assert g.extend(i, j, left=True).tolist() == [slow(a - 1, b - 1, -1) for a, b in zip(i, j)]


def test_long_text_and_small_chunks(monkeypatch):
    monkeypatch.setattr(R, "_TRIED", 1000)
    docs = [["x"] * 5000, [str(i % 700) for i in range(3000)], [], [str(i) for i in range(2000)]]
    w = split(pa.array([" ".join(d) for d in docs]))
    assert list(zip(*R.find_runs(w.codes, w.offsets))) == [(0, 0, 5000, 1), (1, 0, 3000, 700)]


def test_split_words():
    texts = [None, "", " \t", "a", "b\x0bb ", "é\x85x y\x1f a", "a"]
    w = split(pa.array(texts))
    for i, t in enumerate(texts):
        assert [w.distinct[c].as_py() for c in w.codes[w.offsets[i]:w.offsets[i + 1]]] == WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op11_periodic_runs"](spark, SF).collect()


def test_query_equals_brute_force(spark, rows):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        assert tuple(r)[1:8] == slow_row(r.doc_id, texts[r.doc_id])


def test_odd_rows(spark):
    rep = "one two three " * 9
    data = [(1, rep, "x"), (1, rep, "x"), (None, rep, None), (2, None, "y"), (3, "", "y"), (4, " \n ", "y"),
            (5, "z " * 40000, "y"), (6, "short text", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string")
    got = R.digest(R.periodic_runs(R.with_repeats(docs))).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:8]) for r in got) == sorted(
        (str(i), *(slow_row(i, t) if i != None and i != 5 else slow_row("x", t) if i is None else  # noqa: E711
                   (1, 0, 40000, 1, 40000000, hashlib.sha256(b"0,40000,1\n").hexdigest(), hashlib.sha256(b"z").hexdigest())))
        for i, t, _ in data)
    assert R.periodic_runs(docs.limit(0)).collect() == []
    named = docs.selectExpr("concat('d', doc_id) AS name", "text AS body")
    assert R.periodic_runs(named, id_col="name", text_col="body").filter("name = 'd1'").first().runs[0].period == 3
