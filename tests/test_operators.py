"""Literal expectations from the source's smoke scripts and operator units."""

import json

from pyspark.sql import functions as F

from weft.functions import jsonx
from weft.functions import text as T
from weft.operators import quota, responses, vectors
from weft.operators.ordering import row_number_within


def test_normalize_category_and_question_id(spark):
    df = spark.createDataFrame([("Knowledge III",), ("Social Science",), ("Writing",)], "c string")
    got = [r[0] for r in df.select(T.normalize_category("c")).collect()]
    assert got == ["Knowledge_III", "Social_Science", "Writing"]
    r = spark.range(1).select(T.question_id(F.lit("Writing"), F.lit(123)).alias("q"),
                              T.question_id(F.lit("Writing"), F.lit(12345)).alias("q2")).first()
    assert r.q == "drill_Writing_0123" and r.q2 == "drill_Writing_12345"


def test_batch_size_rule(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 8, 10, 15)], "n int")
    got = [r[0] for r in df.select(quota.batch_size(F.col("n"), 3, 5)).collect()]
    assert got == [1, 1, 1, 5, 5, 5, 5]


def test_quota_18_over_9(spark):
    cats = ["c%d" % i for i in range(9)]
    ex = spark.createDataFrame([], "category string, n_existing bigint")
    q = quota.remaining_quota(spark, ex, cats, 18).collect()
    assert sorted(r.remaining for r in q) == [2] * 9


def test_clean_text_unicode_whitespace(spark):
    df = spark.createDataFrame([("<think>a\nb</think>  x  y  ",)], "t string")
    assert df.select(T.clean_text("t")).first()[0] == "x y"
    assert df.select(T.after_think("t")).first()[0] == "  x  y  "


def test_suggested_wait_and_error_class(spark):
    df = spark.createDataFrame([("429 Too many; retry after 17", 3), ("429", 0), ("500 boom", 7),
                                ("weird", 1)], "e string, a int")
    r = df.select(T.suggested_wait("e", "a"), T.error_class("e")).collect()
    assert [x[0] for x in r] == [17, 35, 128, 2]   # only rate limits have the default and the cap
    assert [x[1] for x in r] == ["Rate Limit (429)", "Rate Limit (429)", "Server Error (500)", "Other"]


def test_responder_hook(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id int, prompt string")
    out = responses.respond_with(df, lambda ps: [p.upper() for p in ps], concurrency=4, batch_size=7)
    got = {r.id: r.response for r in out.collect()}
    assert got[7] == "P7" and len(got) == 50


def test_null_group_is_numbered(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, g string")
    got = row_number_within(df, ["g"], ["id"], out="rn").collect()
    assert sorted((r.id, r.rn) for r in got) == [(1, 1), (2, 1), (3, 2)]


def test_last_response_counts(spark):
    req = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    table = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2), ("k2", None, 1)], "key string, response string, timestamp int")
    got = {r.key: (r.response, r.hit) for r in responses.respond_from_table(req, table).collect()}
    assert got == {"k1": ("new", True), "k2": (None, True), "k3": (None, False)}


def test_json_strings_equal_json_dumps(spark):
    texts = ["", 'a"b\\c', "x\ny\tz", "".join(map(chr, range(0x20))), "é 中 \x7f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.j for r in df.select("i", jsonx.json_str("t").alias("j")).collect()} == {
        i: json.dumps(t, ensure_ascii=False) for i, t in enumerate(texts)}


def test_zero_and_null_vectors_are_skipped(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {(r.id, r.neighbor_id) for r in vectors.knn(df, "id", "v", 2).collect()} == {(1, 2), (2, 1)}
