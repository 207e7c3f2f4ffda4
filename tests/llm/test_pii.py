"""Base spans against the plain patterns in Python, the label model, redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.llm import pii
from weft.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0,
            "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    found = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if ok(k, m.group())]
    return sorted(found)


ODD = ["", "a@b.c+d@e.f g@h", "x@y@z.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0.0.0.0 00000255.1.1.1 1.2.3 12.34.56.789.1",
       "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112 1234567890123456789012", "+1 (375) 555-4393 4111111111111111 +123 +1+1 555",
       "\x01a@b.c\x02 \x03 1.1.1.1", "é@b.c ñ 日本 a@b.co 😀 +1 234 567 8901", "1" * 40_000, "a" * 50_000 + "@", "a.b" * 20_000 + "@x.yz", "+1" + " 2" * 30_000,
       "a@b.c " * 3000, "..@-.-", "%@a.b_@c.d", "5500 0000 0000 0004\n5500000000000004", "password=abc123def456 token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", None]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", " ", "-", "+", "1", "255", "4111111111111111", "(", ")", "é", "\n", "_", "%", "9", "300"]
    data = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    got = pii.base_spans(docs, "text").select("doc_id", "_base").collect()
    assert len(got) == len(data)
    for r in got:
        assert [tuple(x) for x in r._base] == brute(data[r.doc_id] or ""), repr((data[r.doc_id] or "")[:200])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = QUERIES["op8_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    added = 0
    for r in got:
        want = brute(texts[r.doc_id] or "")
        string = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(string.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(string.split(",") if string else []) <= set(spans)
        for kind, a, b in (x.split(":") for x in spans):
            if kind not in pii.BASE:
                added += 1
                word = texts[r.doc_id][int(a):int(b)]
                assert len(word) >= 8 and re.search("[0-9@]", word), word
    assert added > 0


def test_em_finds_reliabilities():
    """Three labelers of known quality on a class of 30 %."""
    rng = random.Random(1)
    truth, patterns, by = [], {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        votes = [(0 if rng.random() < 0.2 else 2 if (rng.random() < right) == y else 1) for right in (0.95, 0.85, 0.7)]
        p = sum(v * 3**k for k, v in enumerate(votes))
        patterns[p] = patterns.get(p, 0) + 1
        by.setdefault(p, []).append(y)
        truth.append(y)
    q, rates, share = pii.em(patterns, 3, 200)
    assert abs(share - 0.3) < 0.05
    assert all(abs(q[p] - sum(ys) / len(ys)) < 0.15 for p, ys in by.items() if len(ys) > 200)
    assert rates[0][0][2] > rates[1][0][2] > rates[2][0][2]


def test_classifier_separates():
    w = pii.fit_classifier({0b01: (100, 95.0), 0b10: (100, 3.0), 0b11: (50, 45.0)}, 2)
    z = lambda m: sum(a * (m >> k & 1) for k, a in enumerate(w)) + w[-1]
    assert z(0b01) > 0 > z(0b10)


def test_added_spans_and_redaction(spark):
    rows = [(i, f"some words number {i} and version 2.0. then password=9f{i}ab77c{i}d000 or token = \"{i:08d}a9b{i:08d}cc0de{i:08d}\" end {i % 9}.") for i in range(200)]
    rows += [(900, "mail a.b@mail.example.com or +1 (375) 555-4393 now"), (901, None), (902, "clean text"), (None, "1.2.3.4 end"), (903, "é 😀 x@y.zz é")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string").repartition(3)
    model = pii.train(docs)
    found = pii.find(docs, model)
    assert found.columns == ["doc_id", "text", "kind", "spans"]
    texts = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert texts[900] == "mail [EMAIL] or [PHONE] now" and texts[901] is None and texts[902] == "clean text"
    assert texts[None] == "[IP] end" and texts[903] == "é 😀 [EMAIL] é"
    assert all(t.count("[SECRET]") == 2 and "2.0" in t for i, t in texts.items() if i is not None and i < 200)
    empty = docs.limit(0)
    assert pii.digest(pii.find(empty, pii.train(empty))).count() == 0


def test_overlapping_spans_are_one_run(spark):
    docs = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string").withColumn("spans", F.expr(
        "array(named_struct('start',1,'kind',0,'end',4), named_struct('start',2,'kind',1,'end',3), named_struct('start',3,'kind',2,'end',6), named_struct('start',6,'kind',3,'end',7))"))
    assert pii.redact(docs).first().text == "0[EMAIL][PHONE]789"


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = pii.digest(pii.find(docs, pii.train(docs)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
