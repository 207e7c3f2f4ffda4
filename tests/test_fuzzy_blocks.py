"""J7 block by block: the pairs of brute force, whatever the blocks; no row for a
window, a segment or a candidate."""

import random

import numpy as np
import pytest

from tests.test_fuzzy import dp_lcs
from tests.test_fuzzy_candidates import edited
from weft.operators import dedup
from weft.operators import fuzzy_blocks as FB


def test_short_lcs_matches_dp():
    rnd = random.Random(4)
    pairs = [tuple("".join(rnd.choice("abé語c") for _ in range(rnd.randint(1, n))) for n in (80, 64)) for _ in range(300)] + [("x" * 64, "x" * 64)]
    assert FB.short_lcs(*map(list, zip(*pairs))).tolist() == [dp_lcs(*p) for p in pairs]


def test_lcs_between_common_start_and_end():
    rnd = random.Random(8)
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 60)))
        b = edited(rnd, a, rnd.randint(0, 9), "abé")
        n = dp_lcs(a, b)
        assert dedup.lcs_at_least(a, b, 0) == dedup.lcs_at_least(a, b, n) == n


@pytest.mark.parametrize("cut", [False, True])
def test_pairs_of_brute_force(spark, monkeypatch, cut):
    """Short and long texts around the threshold, in whole bands and in cut ones."""
    if cut:
        monkeypatch.setattr(FB, "INDEX_CHARS", 900)
        monkeypatch.setattr(FB, "PROBE_CHARS", 1500)
    rnd = random.Random(6)
    texts = {}
    for k in range(40):
        s = "".join(rnd.choice("abcdefgh 語") for _ in range(rnd.choice([5, 30, 64, 65, 120, 400])))
        for _ in range(4):
            texts.setdefault(edited(rnd, s, rnd.randint(0, max(2, len(s) // 9)), "xyz"), len(texts))
    rows = [(v, k) for k, v in texts.items() if k]
    got = {(r.id_a, r.id_b): r.lcs for r in dedup.similar_pairs(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    lcs = {(i, j): dp_lcs(a, b) for i, a in rows for j, b in rows if i < j and abs(len(a) - len(b)) < 50}
    size = dict((i, len(a)) for i, a in rows)
    want = {p: n for p, n in lcs.items() if 200 * n >= 95 * (size[p[0]] + size[p[1]])}
    assert len(want) > 30 and got == want


def test_addresses_of_one_site_make_no_row_but_pairs(spark):
    """Addresses that differ in a number alone: what is shuffled are the texts."""
    rows = [(i, f"https://blog.example.org/en/{i * 7919 % 100003}.html?page=2&ref=x") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, s string")
    pairs = dedup.similar_pairs(df, "id", "s")
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().toString()
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    some = random.Random(1).sample(range(1500), 60)
    want = {(i, j) for i in some for j in some if i < j and 200 * dedup.lcs_length(rows[i][1], rows[j][1]) >= 95 * (len(rows[i][1]) + len(rows[j][1]))}
    assert want == {(i, j) for i, j in got if i in some and j in some} and len(got) > 10000


def test_block_counts_bound_memory_and_copies():
    (_, s, t), = FB.block_counts([(70, 10**6, 10**9, 2 * 10**6, 2 * 10**9)])
    assert 10**9 / s <= FB.INDEX_CHARS and 2 * 10**9 / t <= FB.PROBE_CHARS
    (_, s, t), = FB.block_counts([(38, 34_000, 1_300_000, 60_000, 2_300_000)])
    assert s * t >= 20 and 1.3 * t + 2.3 * s <= FB.COPIED / 1e6
    assert np.all([x[1:] == (1, 1) for x in FB.block_counts([(50, 10, 700, 20, 1500)])])
