"""Fingerprints: next texts and digests by brute force, likeness against the
generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm.fingerprints import fingerprint

SF = "/root/testdata/sf0.001"


UNSPACED = "\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f\u3041-\u3096\u30a1-\u30fa\u3400-\u9fff"


def weights(t):
    """Words; of a run of a script without spaces, three neighbours each and
    the last two."""
    out = Counter()
    for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()):
        rest = 0
        for m in re.finditer(f"[{UNSPACED}]{{3,}}", w):
            out.update([w[rest:m.start()]] + [w[i:i + 3] for i in range(m.start(), m.end() - 2)])
            rest = m.end() - 2
        out[w[rest:]] += 1
    del out[""]
    return out


def jaccard(a, b):
    a, b = weights(a), weights(b)
    if not a or not b:
        return float(not a and not b)
    return sum((a & b).values()) / sum((a | b).values())


def edit(t, nxt):
    k = len(t) // 4
    return t[:len(t) - k] + nxt[:k]


def check(rows, got, tolerance):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(order)
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        want.append((i, len(t), hashlib.sha256(edit(t, nxt).encode()).hexdigest(), t, nxt))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    errors = []
    for r, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == w[:3]
        errors += [r.near_edited - jaccard(w[3], edit(w[3], w[4])), r.near_next - jaccard(w[3], w[4])]
        if not weights(w[3]):
            assert set(r.fingerprint) == {"0"}
    assert abs(sum(errors) / len(errors)) < tolerance and max(map(abs, errors)) < 0.45


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], fingerprint(docs, samples=64).collect(), 0.02)


def test_collision_rate_is_the_weighted_similarity(spark):
    """One pair with known weights, many samples: sum of minima 7, of maxima 15."""
    a, b = "a a a a b b c d d", "a a b b b b b b c e e e"
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    r = fingerprint(docs, samples=2000).filter("doc_id = 1").first()
    assert abs(r.near_next - jaccard(a, b)) < 0.04


def test_odd_rows(spark):
    rows = [(5, "x y"), (5, "x y"), (1, None), (2, ""), (3, " \n"), (None, "lost id"), (9, "é" * 9), (10**14, "日本 語 テキスト"), (7, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, place string").repartition(3)
    got = fingerprint(docs, samples=8).collect()
    check(rows, got, 0.5)
    one, two = [r.fingerprint for r in got if r.doc_id == 5]
    assert one == two and [r.near_next for r in got if r.doc_id == 1] == [1.0]


def test_scripts_without_spaces(spark):
    """400 characters in one word, of which the next text has the first 300."""
    letters = [chr(0x4e00 + 37 * i % 5000) for i in range(700)]
    a, b = "".join(letters[:400]), "".join(letters[:300] + letters[400:500])
    rows = [(1, a), (2, b), (3, "x" + a[:9] + "y z" + b[:2]), (4, "no such letters")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint(docs, samples=512).collect()
    check(rows, got, 0.1)
    first = min(got, key=lambda r: r.doc_id)
    assert abs(first.near_next - jaccard(a, b)) < 0.1 and first.near_next > 0.4


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_ids_of_other_types(spark, kind):
    """As with numbers: the next text is that of the next id in its type's order."""
    docs = spark.range(300).select(F.expr("date'2020-01-01' + cast(id as int)" if kind == "date" else f"cast(id as {kind})").alias("doc_id"),
                                   F.format_string("text %d with words %d", "id", F.col("id") % 7).alias("text"))
    got = fingerprint(docs, samples=8)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = {r.doc_id: r for r in got.collect()}
    order = sorted((r.doc_id, r.text) for r in docs.collect())
    for n, (i, t) in enumerate(order):
        assert rows[i].edited_sha256 == hashlib.sha256(edit(t, order[(n + 1) % 300][1]).encode()).hexdigest()


def test_samples_that_are_no_multiple_of_a_block(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    short, long = ({r.doc_id: r.fingerprint for r in fingerprint(docs, samples=n).collect()} for n in (5, 16))
    assert all(len(short[i]) == 40 and long[i].startswith(short[i]) for i in (1, 2))


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    docs = spark.createDataFrame([(4, "lone text here now")], "doc_id long, text string").limit(n)
    got = fingerprint(docs, samples=8).collect()
    assert len(got) == n and all(r.near_next == 1.0 for r in got)


def test_ids_all_null(spark):
    docs = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert sorted(r.n_chars for r in fingerprint(docs, samples=4).collect()) == [1, 1]


def test_one_shuffle_of_texts_and_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = fingerprint(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert fingerprint(docs).filter(F.col("near_edited") > 1).count() == 0


def test_error_of_the_production_setting(spark):
    """The registered query: root mean square error against the exact likeness,
    within a tenth of the 0.0625 that 64 samples have at a likeness of 0.5."""
    from weft.llm.queries import QUERIES
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for n, (i, t) in enumerate(docs):
        exact = jaccard(t, edit(t, docs[(n + 1) % len(docs)][1]))
        errors.append(got[i].near_edited - exact)
        assert len(got[i].fingerprint) == 8 * 64
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 1.1 * 0.0625


def test_query_on_a_larger_table(spark):
    """The optimizer once stopped on the literal search in the id's column."""
    from weft.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_fingerprints"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
