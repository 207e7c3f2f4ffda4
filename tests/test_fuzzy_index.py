"""J7 inside a block: no similar pair is lost, neither by chunks nor by signatures; a
family of similar texts is not verified pair by pair for the rows that stay."""

import random

import numpy as np
import pytest

from tests.test_fuzzy import brute_removed, dp_lcs
from tests.test_fuzzy_candidates import edited
from weft.operators import dedup
from weft.operators import fuzzy_blocks as FB
from weft.operators import fuzzy_index as FI
from weft.operators.fuzzy import Budget


def similar(texts, t):
    """(s, r): lcs of all similar pairs, s shorter or as long and before r."""
    out = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if (len(a), i) < (len(b), j) and len(a) * (200 - t) >= len(b) * t and 200 * (n := dp_lcs(a, b)) >= t * (len(a) + len(b)):
                out[i, j] = n
    return out


def families(rnd, lengths, letters, edits, many=5):
    texts = {}
    for n in lengths:
        s = "".join(rnd.choice(letters) for _ in range(n))
        for _ in range(many):
            texts.setdefault(edited(rnd, s, rnd.randint(0, max(1, int(edits * n))), letters), None)
    return [x for x in texts if x]


@pytest.mark.parametrize("t", [95, 88])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh 0123456789", "".join(map(chr, range(0x4E00, 0x4E00 + 90)))], ids=["few", "some", "many"])
def test_signatures_lose_no_pair(t, letters):
    """Few letters, some, and more than the signature has bits."""
    texts = families(random.Random(t), [1, 2, 9, 10, 19, 20, 21, 33, 40, 55, 60] * 2, letters, .12)
    order = np.array(random.Random(1).sample(range(len(texts)), len(texts)))
    s, r, lcs = FI.near_short(texts, order, len(texts), np.arange(len(texts)), t)
    got = {(i, j): n for i, j, n in zip(s.tolist(), r.tolist(), lcs.tolist())}
    want = {}
    for (i, j), n in similar(texts, t).items():
        want[(j, i) if len(texts[i]) == len(texts[j]) and order[i] > order[j] else (i, j)] = n
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("t", [95, 88, 60])
def test_chunks_lose_no_pair(t):
    """Also pairs that differ at the start or the end alone, and at a threshold that no chunk bounds."""
    rnd = random.Random(t)
    texts = families(rnd, [65, 70, 90, 120, 121, 200, 333], "abcdefgh ", .06)
    texts += [x[k:] for x in texts[:6] for k in (3, 6)] + [x + "zyx" * k for x in texts[:6] for k in (1, 2)]
    texts = list(dict.fromkeys(texts))
    by_band = {}
    for i, j in (want := similar(texts, t)):
        by_band.setdefault(int(Budget(t).band(len(texts[i]))), []).append((i, j))
    assert len(want) > 40
    for band, pairs in by_band.items():
        own = [i for i, x in enumerate(texts) if int(Budget(t).band(len(x))) == band]
        s, r, _ = map(np.concatenate, zip(*FI.Chunks([texts[i] for i in own], Budget(t)).sharing(texts)))
        assert set(pairs) <= {(own[i], j) for i, j in zip(s.tolist(), r.tolist())}


def test_addresses_of_one_site_are_not_all_compared(monkeypatch):
    rows = [f"https://blog.example.org/en/{k}.html?page=2" for k in random.Random(2).sample(range(100000, 10**6), 1500)]
    seen, real = [], FI.indels
    monkeypatch.setattr(FI, "indels", lambda a, b, most: seen.append(len(a)) or real(a, b, most))
    s, r, _ = FB.similar_in_block(rows, np.arange(1500), 1500, np.arange(1500), Budget(95), None)
    some = random.Random(3).sample(range(1500), 80)
    want = {(i, j) for i in some for j in some if i < j and 200 * dedup.lcs_length(rows[i], rows[j]) >= 95 * 2 * len(rows[0])}
    assert want == {(i, j) for i, j in zip(s.tolist(), r.tolist()) if i in some and j in some}
    assert sum(seen) < 0.4 * 1500 * 1499 / 2


def test_rows_of_a_family_are_not_verified_pair_by_pair(spark, monkeypatch):
    """80 copies of a text with a few edits, 3,000 similar pairs: each row needs one."""
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = [(i, edited(rnd, base, 3, "xyz")) for i in range(80)] + [(100 + i, edited(rnd, base, 60, "xyz")) for i in range(5)]
    calls, real = spark.sparkContext.accumulator(0), dedup.lcs_at_least

    def counted(a, b, need):
        calls.add(1)
        return real(a, b, need)
    monkeypatch.setattr(dedup, "lcs_at_least", counted)
    kept, pairs = dedup.fuzzy_dedup(spark.createDataFrame(rows, "id long, s string"), "s", "id")
    assert {r.id for r in kept.collect()} == {i for i, _ in rows} - brute_removed(rows)
    assert 79 <= calls.value < 400
    monkeypatch.undo()
    assert pairs.count() > 3000


def test_short_texts_give_one_pair_a_row_for_the_dedup():
    rows = [f"https://blog.example.org/en/{100000 + k}.html?page=2" for k in range(300)]
    at = np.arange(300)
    whole, one = (FB.similar_in_block(rows, at, 300, at, Budget(95), None, every) for every in (True, False))
    later = [np.maximum(x[0], x[1]).tolist() for x in (whole, one)]
    assert len(whole[0]) > 10 * 300 and sorted(later[1]) == sorted(set(later[0]))
