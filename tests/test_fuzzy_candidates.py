"""J7 candidates: no similar pair is lost, for any text; the bitmap only thins."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.operators import fuzzy as FZ
from tests.test_fuzzy import dp_lcs


def edited(rnd, s, n, letters):
    s = list(s)
    for _ in range(n):
        at = rnd.randrange(len(s) + 1)
        if s and rnd.random() < .5:
            del s[min(at, len(s) - 1)]
        else:
            s.insert(at, rnd.choice(letters))
    return "".join(s)


def common(s, r, b, counts):
    """Segments of s that a window of r meets, and how many are needed."""
    keys, i, p, k, m = FZ.text_segments(s, b, counts)
    win, q = FZ.text_windows(r, b, None)
    at = {}
    for x, y in zip(win.tolist(), q.tolist()):
        at.setdefault(x, []).append(y)
    return sum(any(abs(y - z) <= k for y in at.get(x, [])) for x, z in zip(keys.tolist(), p.tolist())), m


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 900), st.sampled_from(["ab", "abcdefghij ", "語x é"]), st.sampled_from([95, 90, 99]))
def test_similar_pairs_share_enough(seed, n, letters, t):
    rnd, b = random.Random(seed), FZ.Budget(t)
    a = "".join(rnd.choice(letters) for _ in range(n))
    c = edited(rnd, a, rnd.randint(0, max(1, (100 - t) * 2 * n // 100)), letters)
    s, r = sorted((a, c), key=len)
    if s and 200 * dp_lcs(s, r) >= t * (len(s) + len(r)):
        any_counts = np.random.default_rng(seed).integers(0, 5, 1 << FZ.COUNT_BITS)
        for counts in (None, any_counts):
            got, need = common(s, r, b, counts)
            assert got >= need >= 1


def test_window_hash_is_of_its_characters():
    w = FZ.Windows(FZ.codes("abcabcab\0\0"))
    h = w.hashes(np.arange(8), 3)
    assert h[0] == h[3] != h[1] and len(set(h[:3].tolist())) == 3
    assert w.hashes(np.array([8]), 1) != w.hashes(np.array([8]), 2)


def test_bitmap_keeps_every_key_of_the_index(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, 300)))) for i in range(60)]
    base = spark.createDataFrame(rows, "id long, s string").selectExpr("*", "cast(length(s) AS long) AS n")
    b = FZ.Budget(95)
    index = FZ.segments(base, b)
    bits = FZ.sketch(index.select("key"))
    for _, s in rows:
        whole, q = FZ.text_windows(s, b, None)
        thin, p = FZ.text_windows(s, b, bits)
        mine = FZ.text_segments(s, b)[0]
        assert set(mine.tolist()) <= set(thin.tolist()) <= set(whole.tolist()) and len(thin) < 0.6 * len(whole) + 60


@pytest.mark.parametrize("t", [90, 95])
def test_one_text_that_most_rows_resemble(spark, t):
    """Two hundred rows of one hot text with single edits: all pairs are found."""
    rnd = random.Random(3)
    hot = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    rows = [(i, edited(rnd, hot, 1, "xyz") if i % 3 else "".join(rnd.choice("abcdefgh ") for _ in range(120))) for i in range(200)]
    texts = dict(rows)
    got = {(r.id_a, r.id_b) for r in FZ.candidate_pairs(spark.createDataFrame(rows, "id long, s string"), "id", "s", t).collect()}
    want = {(i, j) for i in texts for j in texts if i < j and 200 * dp_lcs(texts[i], texts[j]) >= t * (len(texts[i]) + len(texts[j]))}
    assert len(want) > 8000 and want <= got


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "b"), (5, "x" * 50), (6, "x" * 51), (None, "x" * 52)]
    got = FZ.candidate_pairs(spark.createDataFrame(rows, "id long, s string").where("id IS NOT NULL"), "id", "s")
    assert {(r.id_a, r.id_b) for r in got.collect()} == {(5, 6)}
    assert FZ.candidate_pairs(spark.createDataFrame([], "id long, s string"), "id", "s").collect() == []
