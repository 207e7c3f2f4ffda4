"""Line dedup by shared pairs of lines: inline passages, runs by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weft.llm.line_dedup import _with_lines, line_dedup


def sentences(rng, words, size):
    out = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return "".join(w + (". " if k % size == size - 1 or k == words - 1 else " ") for k, w in enumerate(out))


def removed(spark, rows, **args):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in line_dedup(docs, **args).collect()}


def test_inline_passages_of_51_to_60_words(spark):
    rng = random.Random(5)
    rows, passages = [], {}
    for n, words in enumerate(range(51, 61)):
        for m, size in enumerate((6, 11, 20)):
            p = sentences(rng, words, size)
            for copy in range(2):
                i = 1000 * copy + 10 * n + m
                rows.append((i, sentences(rng, rng.randint(20, 90), 9) + p + sentences(rng, rng.randint(20, 90), 9)))
                passages[i] = p
    have = removed(spark, rows)
    for i, t in rows:
        assert have[i] == (t if i < 1000 else t.replace(passages[i], ""))


def test_common_sentences_alone_are_no_passage(spark):
    """Sentences that each stand elsewhere, but never beside each other."""
    rng = random.Random(6)
    common = [sentences(rng, 8, 8) for _ in range(6)]
    rows = [(i, sentences(rng, 30, 10) + c + sentences(rng, 30, 10)) for i, c in enumerate(common)]
    rows.append((50, "".join(common)))
    assert removed(spark, rows) == dict(rows)


def brute(rows, min_words):
    """Texts without the windows of whole lines that stand in an earlier place."""
    cut = {i: [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t) if x] for i, t in rows}
    first, windows = {}, []
    for i in sorted(cut):
        u = [x.strip() for x in cut[i]]
        n = [len(x.split()) for x in u]
        spans = set()
        for a in range(len(u)):
            b = next((b for b in range(a + 1, len(u) + 1) if sum(n[a:b]) >= min_words), None)
            spans |= {(a, b)} if b else set()
        for b in range(len(u), 0, -1):
            a = next((a for a in range(b - 1, -1, -1) if sum(n[a:b]) >= min_words), None)
            spans |= {(a, b)} if a is not None else set()
        for a, b in sorted(spans):
            first.setdefault(tuple(u[a:b]), (i, a))
            windows.append((i, a, b, tuple(u[a:b])))
    gone = {(i, k) for i, a, b, key in windows if first[key] != (i, a) for k in range(a, b)}
    return {i: "".join(x for k, x in enumerate(u) if (i, k) not in gone) for i, u in cut.items()}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_windows_against_brute_force(spark, seed):
    """Few lines, so pairs repeat often, and longer copies of earlier places."""
    rng = random.Random(seed)
    pool = [sentences(rng, rng.randint(1, 12), 50) for _ in range(25)]
    rows = []
    for i in range(40):
        t = [rng.choice(pool) + rng.choice(["", "", "", "\n", "\n\n"]) for _ in range(rng.randint(1, 20))]
        if rows and rng.random() < 0.5:
            u = [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", rng.choice(rows)[1]) if x]
            a = rng.randrange(len(u))
            t[len(t) // 2:len(t) // 2] = u[a:a + rng.randint(1, 8)]
        rows.append((i, "".join(t)))
    assert removed(spark, rows, min_words=25) == brute(rows, 25)


def test_pairs_from_unrelated_places_are_no_passage(spark):
    """Every pair of lines stands in some earlier text, the passage in none; then its copy goes."""
    rng = random.Random(12)
    s = [sentences(rng, 9, 9) for _ in range(6)]
    rows = [(k, sentences(rng, 30, 10) + s[k] + s[k + 1] + sentences(rng, 30, 10)) for k in range(5)]
    own = sentences(rng, 30, 10)
    rows += [(10, "".join(s)), (11, own + "".join(s) + sentences(rng, 30, 10))]
    have = removed(spark, rows)
    assert all(have[i] == t for i, t in rows if i <= 10)
    assert have[11] == rows[-1][1].replace("".join(s), "")


def test_many_lines_without_words(spark):
    """A window over more lines than are looked at one by one."""
    rng = random.Random(13)
    passage = "\n\n\n\n".join(words(rng, 30)) + "\n"
    rows = [(i, sentences(rng, 20, 10).strip() + "\n" + passage + sentences(rng, 20, 10)) for i in range(3)]
    have = removed(spark, rows)
    assert have == {i: t if i == 0 else t.replace(passage, "") for i, t in rows}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_one_line_passages(spark):
    """Repeated lines without a sentence end inside, each on a line of its own."""
    rng = random.Random(8)
    han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(120))
    thai = "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(220))
    passages = [" ".join(words(rng, 26)), " ".join(words(rng, 55)), " | ".join(words(rng, 55)), " ".join(words(rng, 60)).upper(),
                "- " + ", ".join(words(rng, 55)), han, "".join(c + "。" * (k % 20 == 19) for k, c in enumerate(han[::-1])), thai]
    rows = []
    for n, p in enumerate(passages):
        rows += [(i, sentences(rng, 30, 9).strip() + "\n" + p + "\n" + sentences(rng, 30, 9)) for i in (n, 100 + n)]
    short = " ".join(words(rng, 24)), han[:40]
    rows += [(i, sentences(rng, 30, 9).strip() + "\n" + s + "\n" + sentences(rng, 30, 9)) for k, s in enumerate(short) for i in (200 + k, 300 + k)]
    have = removed(spark, rows)
    for i, t in rows:
        assert have[i] == (t.replace(passages[i - 100] + "\n", "") if 100 <= i < 200 else t)


def test_passages_inside_long_lines_without_sentences(spark):
    """What is cut at places chosen by hash: most of the passage goes."""
    rng = random.Random(10)
    rows, passages = [], []
    for n in range(20):
        passages.append(" ".join(words(rng, 120)) + " ")
        rows += [(i, " ".join(words(rng, 80)) + " " + passages[n] + " ".join(words(rng, 80))) for i in (n, 100 + n)]
    have = removed(spark, rows)
    assert all(have[i] == t for i, t in rows if i < 100)
    gone = [len(t) - len(have[i]) for i, t in rows if i >= 100]
    assert sum(gone) > 0.85 * sum(map(len, passages)) and all(g <= len(p) for g, p in zip(gone, passages))


def test_fine_lines_keep_every_byte(spark):
    rng = random.Random(11)
    rows = [("",), ("a| b|c\t" * 60,), ("x" * 5000,), ("中" * 400 + "。" + "文 " * 300,), ("\x01" + "y " * 400,), ("🙂é" * 300 + "\r\n",),
            (" ".join(words(rng, 3000)),)]
    docs = _with_lines(spark.createDataFrame(rows, "_t string"))
    assert docs.filter(F.array_join("_u", "") != F.col("_t")).count() == 0
    assert docs.filter(F.length("_t") > 10_000).select(F.size("_u")).first()[0] > 300


def test_cheap_cuts_and_counts_equal_the_plain_ones(spark):
    """Long lines cut at marked signs, and words counted by bytes first, as by the rules."""
    import math
    import random
    import re

    from pyspark.sql import functions as F

    from weft.llm import line_dedup as L
    rng = random.Random(5)
    signs = [",", ";", ":", ")", "]", " ", " ", "\t", "|", "。", "！", "；", "،", "۔", "…", "a", "é", "中"]
    rows = [("".join(rng.choices(signs, k=rng.randint(1, 40))),) for _ in range(400)] + [("a, b\x01; c",), (", ",), ("",)]
    behind = r"(?<=[,;:)\]] )|(?<=[\t|。！？；，、।۔؟…])"
    cut = spark.createDataFrame(rows, "x string").select("x", F.filter(L._at_signs(F.col("x")), lambda p: p != "").alias("p")).collect()
    assert all(r.p == [p for p in re.split(behind, r.x) if p] for r in cut)

    def count(x):
        spaced = len(re.split("[ \t]+", x)) if x else 0
        return max(spaced, math.ceil(len(re.findall("[一-鿿぀-ヿ]", x)) / 2 + len(re.findall("[฀-๿]", x)) / 4))

    kinds = ["é", "ü", "中", "あ", "ก", "b", " ", "😀", "ж"]
    words = [("".join(rng.choices(kinds, weights=[rng.random() ** 4 for _ in kinds], k=rng.randint(0, 60))).strip(" "),) for _ in range(600)]
    got = spark.createDataFrame(words, "x string").select("x", L._words(F.col("x")).alias("n")).collect()
    assert all(r.n == count(r.x) for r in got)
    docs = L._keyed(spark.createDataFrame([(k, x) for k, (x,) in enumerate(words)], "i long, t string"), "i", "t")
    alone = {r._id for r in L._units(docs, 6).filter("_k = 1").collect()}
    plain = {k for k, (x,) in enumerate(words) if len(x.encode()) >= 11 and len(x.encode()) <= L.LONG and count(x) >= 6}
    assert {k for k in alone if len(words[k][0].encode()) <= L.LONG} == plain


def test_windows_keys_stay_small(spark):
    """A window's key is two numbers, however many lines it has, and equal for equal lines only."""
    from weft.llm import line_dedup as L
    rows = [(i, 7, j, 100 + j % 50, (0, 7, j), 1, 1) for i in (0, 1) for j in range(120)]
    pairs = spark.createDataFrame(rows, "_id long, _th long, _j int, _c long, _first struct<_id long, _th long, _j int>, _w1 int, _w2 int")
    found = L._windows(pairs, 25)
    assert dict(found.dtypes)["_k1"] == dict(found.dtypes)["_k2"] == "bigint"
    got = found.collect()
    # 121 lines of a word each: 97 windows, the same from both ends.
    assert sorted((r._id, r._a, r._b) for r in got) == [(i, a, a + 25) for i in (0, 1) for a in range(97)]
    assert all(r._later == (r._id == 1) for r in got)
    assert all(len({(r._k1, r._k2) for r in got if r._a % 50 == a}) == 1 for a in range(50))
    assert len({(r._k1, r._k2) for r in got}) == 50
