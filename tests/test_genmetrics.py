"""Generation metrics against small pure-Python references (sf0.001 pairs)."""

import math
from collections import Counter

import pyarrow as pa
import pytest

from weft.operators import genmetrics as G
from weft.plans import bindings
from tests.conftest import SF001


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j in range(1, len(b) + 1):
            cur = row[j]
            row[j] = prev + 1 if x == b[j - 1] else max(row[j], row[j - 1])
            prev = cur
    return row[-1]


def ngrams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def py_bleu(pairs, order: int = G.BLEU_ORDER) -> float:
    """Corpus BLEU by loops."""
    m = [0] * order
    t = [0] * order
    c = r = 0
    for h, ref in pairs:
        ht, rt = G.TOKEN_PY.findall(h or ""), G.TOKEN_PY.findall(ref or "")
        c += len(ht)
        r += len(rt)
        for n in range(1, order + 1):
            hc, rc = ngrams(ht, n), ngrams(rt, n)
            m[n - 1] += sum(min(v, rc[g]) for g, v in hc.items())
            t[n - 1] += max(len(ht) - n + 1, 0)
    p = [m[i] / t[i] if t[i] else 0.0 for i in range(order)]
    if min(p) <= 0 or c == 0:
        return 0.0
    bp = 1.0 if c > r else math.exp(1 - r / c)
    return 100 * bp * math.exp(sum(math.log(x) for x in p) / order)


def test_counts_of_a_batch_by_loops():
    h = [["a", "b", "a", "b"], [], ["x"], ["a", "a", "a"], ["b"]]
    r = [["a", "b"], ["a"], [], ["a", "a"], ["b", "a", "b"]]
    lists = [pa.array([[], *x], pa.list_(pa.string())).slice(1) for x in (h, r)]
    got = G._counts(lists, 4)
    for k, (x, y) in enumerate(zip(h, r)):
        for n in range(1, 5):
            hc, rc = ngrams(x, n), ngrams(y, n)
            assert got[k, n - 1].tolist() == [sum((hc & rc).values()), sum(hc.values()), sum(rc.values())]
    assert G._counts([x.slice(0, 0) for x in lists], 2).shape == (0, 2, 3)


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


@pytest.fixture(scope="module")
def pairs(spark):
    return bindings.gen_pairs(spark, SF001)


def _py_pairs(pairs):
    return [(r.lang, r.hyp or "", r.ref or "") for r in pairs.collect()]


def test_rouge_l_and_bleu(spark, pairs):
    st = G.pair_stats(pairs, families=("ngram", "lcs"))
    got = {r.lang: r for r in G.corpus_scores(st, by=["lang"]).collect()}
    by_lang = {}
    for lang, h, r in _py_pairs(pairs):
        by_lang.setdefault(lang, []).append((h, r))
    for lang, prs in by_lang.items():
        scores = []
        for h, r in prs:
            ht, rt = G.TOKEN_PY.findall(h), G.TOKEN_PY.findall(r)
            if not ht or not rt:
                scores.append(0.0)
                continue
            lcs = dp_lcs(ht, rt)
            scores.append(f1(lcs / len(ht), lcs / len(rt)))
        assert got[lang].rougeL == pytest.approx(100 * sum(scores) / len(scores), abs=1e-5)
        assert got[lang].bleu == pytest.approx(py_bleu(prs), abs=1e-5)


def test_meteor_and_smoothed_bleu_identities(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e", "x")], "hyp string, ref string, lang string")
    st = G.pair_stats(df)
    r = G.corpus_scores(st, by=["lang"]).collect()[0]
    assert r.bleu == pytest.approx(100.0)
    assert r.sacrebleu == pytest.approx(100.0)
    assert r.rougeL == pytest.approx(100.0)
    assert r.rougeLsum == pytest.approx(100.0)
    assert r.rouge1 == pytest.approx(100.0) and r.rouge2 == pytest.approx(100.0)
    assert r.chrf == pytest.approx(100.0)
    # one chunk, full match: fmean 1, penalty 0.5 * (1/5)^3
    assert r.meteor == pytest.approx(100 * (1 - 0.5 * (1 / 5) ** 3))


def test_null_and_empty_pairs(spark):
    df = spark.createDataFrame([(None, "a b", "x"), ("", None, "x")], "hyp string, ref string, lang string")
    r = G.corpus_scores(G.pair_stats(df), by=["lang"]).collect()[0]
    assert r.bleu == 0.0 and r.rougeL == 0.0 and r.meteor == 0.0


def test_meteor_reference_python():
    h = "the cat sat on the mat".split()
    r = "on the mat the cat sat".split()
    # From the ends: mat-mat, the-the(3), on-on, sat-sat, cat-cat, the-the(1):
    # all six words match, in the chunks "the", "cat sat", "on", "the", "mat".
    assert math.isclose(G._meteor(h, r), 1 - 0.5 * (5 / 6) ** 3)
    assert math.isclose(G._meteor(h, h), 1 - 0.5 * (1 / 6) ** 3)


def test_lines_of_many_pairs_at_once(monkeypatch):
    """ROUGE-Lsum of several pairs in one pass, whatever the batches, as by one table
    a pair of lines with the reference DP's tie rule."""
    import random

    def marks(r, h):
        t = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i, x in enumerate(r, 1):
            for j, y in enumerate(h, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        i, j, out = len(r), len(h), set()
        while i and j:
            if r[i - 1] == h[j - 1]:
                out.add(i - 1)
                i, j = i - 1, j - 1
            elif t[i - 1][j] >= t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    def plain(hyp, ref):
        hc, rc, hits = Counter(t for x in hyp for t in x), Counter(t for x in ref for t in x), 0
        for r in ref:
            for k in sorted(set().union(*(marks(r, h) for h in hyp))):
                if hc[r[k]] > 0 and rc[r[k]] > 0:
                    hits, hc[r[k]], rc[r[k]] = hits + 1, hc[r[k]] - 1, rc[r[k]] - 1
        return hits, sum(map(len, hyp)), sum(map(len, ref))

    rnd = random.Random(5)
    text = lambda: "\n".join(" ".join(rnd.choice("abcdefg"[:rnd.randint(2, 7)]) for _ in range(rnd.choice([0, 1, 5, 70]))) for _ in range(rnd.randint(1, 5)))
    hyps, refs = zip(*[(text(), text()) for _ in range(120)])
    want = [plain(*([x.split() for x in t.split("\n")] for t in p)) for p in zip(hyps, refs)]
    for chunk in (1, 5000, G.LSUM_CHUNK):
        monkeypatch.setattr(G, "LSUM_CHUNK", chunk)
        assert G._lsum_of(hyps, refs) == want


def test_matches_of_large_alphabets_stay_numbers():
    """Six characters of an alphabet of 3,000 do not fit in 63 bits."""
    import random
    rnd = random.Random(2)
    h, r = ("".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(4000)) for _ in range(2))
    h += r[500:900] + h[:50]
    grams = lambda x, n: Counter(x[i:i + n] for i in range(len(x) - n + 1))
    assert G._match_counts(h, r, range(1, 7)) == {n: sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 7)}
    assert not hasattr(G, "_ngrams")     # no dictionary of tuples per pair
