"""Filter audit: rows against a restatement of its rule, the matrix's parts, odd rows."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from weft.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, hash string"


def slow_audit(data, labels):
    best = {}
    for i, q, x in labels:
        if i is not None:
            old = best.get(i, (None, None))
            best[i] = tuple(max((v for v in pair if v is not None), default=None) for pair in zip(old, (q, x)))
    low = {}
    for i, t, _ in data:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    fails = []
    for i, t, part in data:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low[t]}
        fails.append((part or "", {k for k, v in bad.items() if v}, *(v == 1 for v in best.get(i, (None, None)))))
    out, removed_by = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, own in enumerate(order):
                here = [f for f in mine if own in f[1] and not f[1] & set(order[:k])]
                kept = sum(not f[1] & set(order[:k + 1]) for f in mine)
                removed_by[part, own] += len(here)
                out[part, order, k + 1] = [kept, len(here), sum(own in f[1] and bool(f[1] & set(order[:k])) for f in mine),
                                           sum(f[1] == {own} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)]
    return {(p, o, k): (*v, removed_by[p, o[k - 1]]) for (p, o, k), v in out.items()}


def check(spark, data, labels):
    docs = spark.createDataFrame([(*r, "own") for r in data], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = A.audit(docs, marks).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in rows}
    assert len(got) == len(rows)
    assert got == slow_audit(data, labels)


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [None, "", " \n", "SHOUT " * 120, "a | b", "long " * 130]
    for _ in range(14):
        w = [f"w{i}" for i in rng.integers(0, 400, rng.integers(1, 220))]
        pool.append(" ".join(w) + ("" if rng.random() < .6 else " # ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 5))
    data = [(int(i), pool[rng.integers(len(pool))], [None, "", "en", "de"][rng.integers(4)]) for i in rng.integers(0, 150, 250)]
    data += [(None, pool[7], "en"), (None, pool[7], None), (3, "long " * 130, "en"), (3, "long " * 130, "en")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 150, 120)]
    check(spark, data, [*labels, (None, 1, 1), (5, None, None), (6, None, 1), (6, 1, None)])


def test_a_text_that_most_rows_hold(spark):
    data = [(i, "the same text here" if i % 3 else f"own {i}", "en") for i in range(600)]
    check(spark, data, [(1, 1, 0), (2, 0, 1)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert A.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_matrix_is_the_table_of_counts(spark, tmp_path):
    texts = ["a b a", None, "", "c a", "b b b é"] * 7
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, part string").repartition(3)
    A.shards(docs, "id", "text", "part", 10, "#", shard_bytes=12).write.parquet(f"{tmp_path}/s")
    own = spark.read.parquet(f"{tmp_path}/s")
    assert own.count() > 3
    A.numbers(own, bucket_words=12).write.parquet(f"{tmp_path}/n")
    numbered = spark.read.parquet(f"{tmp_path}/n")
    assert numbered.select("bucket").distinct().count() > 1
    number = {r.word: r.number for r in A.vocabulary(numbered).collect()}
    assert sorted(number) == ["a", "b", "c", "é"] and len(set(number.values())) == 4
    word = {n: w for w, n in number.items()}
    got = {}
    for r in A.matrix(own, numbered).collect():
        ptr, cols, n = np.frombuffer(r.indptr, np.int64), np.frombuffer(r.indices, np.int64), np.frombuffer(r.counts, np.int32)
        for k, d in enumerate(r.docs):
            assert len(set(cols[ptr[k]:ptr[k + 1]])) == ptr[k + 1] - ptr[k]
            got[d.id] = {word[c]: m for c, m in zip(cols[ptr[k]:ptr[k + 1]], n[ptr[k]:ptr[k + 1]])}
    assert got == {i: dict(Counter((t or "").split())) for i, t in enumerate(texts)}


def test_facts_count_code_points():
    texts = pa.array(["ÄÖ éa AB", "", "x|", "É" * 30 + "ABCD", "É" * 36 + "ABCD"])
    shard = A._Shard()
    shard.add(pa.array(range(5)), pa.array(["p"] * 5), texts, 10, "|")
    facts = shard.row(1).column("docs").flatten()
    assert facts.field("c").to_pylist() == [True, False, False, True, False]
    assert facts.field("d").to_pylist() == [False, False, True, False, False] and len(set(facts.field("hash").to_pylist())) == 5


def test_a_shard_holds_no_batch(tmp_path):
    text = " ".join(f"word{i % 50}" for i in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(["en"] * 100), pa.array([text] * 100)],
                                       names=["id", "part", "t"])
    path, seen = tmp_path / "batches", []
    with pa.ipc.new_stream(str(path), batch.schema) as out:
        for _ in range(4):
            out.write_batch(batch)
    size = batch.nbytes
    del batch

    def batches():
        with open(path, "rb") as f:
            for b in pa.ipc.open_stream(f):
                yield b
                del b
                seen.append(pa.total_allocated_bytes())
    before = pa.total_allocated_bytes()
    rows = list(A._rows_of(batches(), 0, 10, "#", 1 << 30))
    assert len(rows) == 1 and len(rows[0].column(6)[0]) == 400
    assert max(seen) - before < size / 2
