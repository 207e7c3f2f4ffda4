"""Line dedup against a brute-force version, planted passages, odd rows."""

import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm.line_dedup import line_dedup, lines

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(values, seed=42):
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def brute(rows, divisor, min_words):
    """Texts without repeated passages, by the rules of the docstring."""
    chunked = {}
    for i, t in rows:
        u = [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t or "") if x]
        h = [signed(xxhash.xxh64_intdigest(x.strip(" \t\r\n").encode(), 42)) for x in u]
        e = [x.endswith("\n") for x in u]
        starts = [0]
        for k in range(1, len(u)):
            rolled = hash_longs([h[k - 2] if k >= 2 and not e[k - 2] else None, h[k - 1]]) % divisor == 0
            before = e[k - 1] and k > 1 and not e[k - 2]
            after = e[k - 1] and not e[k] and k < len(u) - 1
            if rolled or before or after:
                starts.append(k)
        th = signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
        chunked[i, th] = u, [(a, b, "\n".join(x.strip(" \t\r\n") for x in u[a:b])) for a, b in zip(starts, [*starts[1:], len(u)]) if b > a]
    where = defaultdict(list)
    for key in sorted(chunked, key=lambda k: (k[0] is not None, k[0] or 0, k[1])):
        for j, (a, b, c) in enumerate(chunked[key][1]):
            where[c].append((key, j))
    out = {}
    for key, (u, chunks) in chunked.items():
        later = [len(where[c]) > 1 and where[c][0] != (key, j) for j, (a, b, c) in enumerate(chunks)]
        gone, j = set(), 0
        while j < len(chunks):
            k = j
            while k < len(chunks) and later[k]:
                k += 1
            if k > j:
                words = sum(len(re.split("[ \n]+", c)) for _, _, c in chunks[j:k])
                a, b = chunks[j][0], chunks[k - 1][1]
                if words >= min_words and b - a >= 2:
                    gone.update(range(a, b))
            j = max(k, j + 1)
        out[key] = "".join(x for n, x in enumerate(u) if n not in gone)
    return out


def compare(spark, rows, divisor=3, min_words=25):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup(docs, divisor, min_words).collect()
    want = brute(rows, divisor, min_words)
    assert len(got) == len(rows)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.text)
    for i, t in rows:
        th = signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
        assert (None if t is None else want[i, th]) in have[i]
    return have


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    out = ""
    for k, w in enumerate(words):
        out += w + (". " if k % 9 == 8 else "\n" if k % 31 == 30 else " ")
    return out


def test_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows)
    compare(spark, rows, divisor=2, min_words=10)


def test_planted_passages(spark):
    rng = random.Random(4)
    own_line, inside = prose(rng, 60).replace("\n", " ").strip() + ".", prose(rng, 90).replace("\n", " ")
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(40, 200)) for _ in range(3)]
        if i % 5 == 0:
            parts.insert(1, "\n" + own_line + "\n")
        if i % 5 == 1:
            parts.insert(1, inside)
        rows.append((i, "".join(parts)))
    have = compare(spark, rows)
    for i, t in rows:
        got = have[i][0]
        if i in (0, 1) or i % 5 > 1:
            assert got == t                             # first occurrences and clean documents stay
        elif i % 5 == 0:
            assert own_line[30:] not in got and len(t) - len(got) >= len(own_line)
        else:
            assert len(t) - len(got) > 0.4 * len(inside)


def test_odd_rows(spark):
    long = "one line of words that is very long indeed. " * 20_000
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a\x01b. c\x01\nd"), (5, "same text. here\n"), (5, "same text. here\n"),
            (None, "lost. id\n"), (8, long), (9, "x"), (10, "no end")]
    compare(spark, rows)
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, _cuts_ string")
    assert line_dedup(docs.limit(0)).count() == 0
    assert line_dedup(docs).columns == docs.columns


def test_lines_keep_every_byte(spark):
    rows = [("",), ("a. b! c? d.\ne\n",), ("\x01x. y\x01",), ("é. 中\r\n",)]
    docs = spark.createDataFrame(rows, "t string")
    assert docs.filter(F.array_join(lines(F.col("t")), "") != F.col("t")).count() == 0


def test_frequent_passage_in_every_document(spark):
    rng = random.Random(9)
    license_text = prose(rng, 80)
    rows = [(i, license_text + "\n" + prose(rng, 30)) for i in range(300)]
    have = compare(spark, rows)
    kept = sum(len(have[i][0]) > len(rows[i][1]) * 0.6 for i in range(300))
    assert kept == 1


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("d", [1, 2, 50])
def test_any_divisor(spark, d):
    rng = random.Random(d)
    p = prose(rng, 60)
    compare(spark, [(i, prose(rng, 50) + p + prose(rng, 20)) for i in range(6)], divisor=d)
