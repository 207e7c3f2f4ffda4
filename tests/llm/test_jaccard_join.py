"""The Jaccard join and its components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weft.llm.components import connected_components
from weft.llm.jaccard_join import could_share, histogram, jaccard_components, shingles
from weft.llm.queries import QUERIES


def token_set(t, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(rows, percent=80):
    """{id: (set size, component)} by an inverted index over whole sets."""
    sets = [(i, token_set(t)) for i, t in rows]
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (_, s) in enumerate(sets):
        common = {}
        for x in s:
            for m in where[x]:
                if m > k:
                    common[m] = common.get(m, 0) + 1
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                parent[find(m)] = find(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_shingles_are_the_sets():
    texts = ["", None, " \t\n", "One", "a b c d", "A b C d e", "a b c d e f a b c d e f", "x\x0by\x0cz\rw v  u", "é É a b c", "a b c", "a b c d  "]
    got = shingles(pa.array(texts), 5)
    assert [len(s) for s in got] == [len(token_set(t)) for t in texts]
    assert len(set(got[4].tolist()) & set(got[5].tolist())) == 0 and got[4].tolist() == got[10].tolist()


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        b = np.unique(np.concatenate([a[:rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        a = np.unique(a)
        assert len(np.intersect1d(a, b)) <= could_share(histogram(a), histogram(b))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op5_jaccard_join"](spark, sf))
    assert got == sorted(brute(rows))
    assert len({c for _, _, c in got}) < len(rows)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_around_the_threshold(spark):
    """Chains of edits, so that links and near misses are many; small blocks."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for size, n, edits in ((60, 40, 3), (200, 60, 8), (30, 30, 2), (8, 30, 1), (3, 10, 1), (120, 80, 6)):
        base = [rng.choice(words) for _ in range(size)]
        texts += family(rng, base, n, edits)
        for _ in range(10):                                   # a walk away from the base
            base = family(rng, base, 1, edits)[0].split()
            texts.append(" ".join(base))
    shared = " ".join(rng.choice(words) for _ in range(50))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute(rows))
    assert rows_of(jaccard_components(docs)) == want
    assert rows_of(jaccard_components(docs, block=4, deal=8, sketch_bits=10)) == want
    assert rows_of(jaccard_components(docs, percent=60)) == sorted(brute(rows, 60))


def test_odd_rows(spark):
    long = " ".join(f"t{i % 5000}x{i // 7}" for i in range(40_000))
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, None), (4, ""), (5, " \n"), (6, "short"), (7, "SHORT"), (8, long), (9, long + " tail"),
            (10, "same id"), (10, "same id"), (11, "x y z")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, c string").repartition(3)
    got = rows_of(jaccard_components(docs))
    assert got == sorted(brute(rows))
    with_null = spark.createDataFrame([(None, "a b c d e f"), (None, "only here"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_components(with_null).collect()) == [(-1, -1), (-1, 5), (5, 5)]
    assert jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, i) for i in range(2000, 2300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_family_with_words_of_their_own_queries_little(spark, monkeypatch):
    """Texts around one base, each with a sixth of its shingles its own: no pair can
    link, although all their prefixes share tokens of the base."""
    from weft.llm import jaccard_join as J
    pairs, written = [], J._written

    def watched(df, name="jaccard"):
        out = written(df, name)
        if out.columns == ["c", "size", "comp", "g"]:
            pairs.append(out.count())
        return out
    monkeypatch.setattr(J, "_written", watched)
    base = [f"w{i}" for i in range(124)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(4):
            w[10 + 25 * k + i % 13] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    got = rows_of(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == sorted(brute(rows))
    assert pairs[0] < len(rows)
