"""Composite jobs (K1, K2, K4, K7, K8, K9, K11) on small literal tables."""

import pytest

from weft.plans import jobs

CATS = ["Coding", "Extraction", "Knowledge_III", "Math", "Reasoning", "Roleplay",
        "Social_Science", "STEM", "Writing"]


def test_plan_generation_quota_two_per_category(spark):
    src = spark.createDataFrame(
        [(f"q{i}", c.replace("_", " "), f"question {i}") for i, c in enumerate(CATS * 2)],
        "question_id string, category string, question string")
    existing = spark.createDataFrame([], "category string")
    plan = jobs.plan_generation(spark, src, existing, CATS, total=18, min_batch=3, max_batch=5)
    rows = plan.collect()
    per_cat = {}
    for r in rows:
        per_cat[r.plan_category] = per_cat.get(r.plan_category, 0) + r.n_items
    assert per_cat == {c: 2 for c in CATS}
    assert all(r.n_items == 1 for r in rows)          # remaining 2 <= min 3 -> single mode
    assert all(len(r.key) == 32 for r in rows)


def test_ingest_thai_valid_english_invalid(spark):
    thai = '{"turns": ["สวัสดีครับ", "ขอบคุณครับ"], "reference": ["a", "b"]}'
    eng = '{"turns": ["hello there", "again"], "reference": ["a", "b"]}'
    text = "Here you go:\n```json\n[" + thai + ", " + eng + ', "junk", null]\n```'
    resp = spark.createDataFrame([(1, "Math", text, ["81", "82"])],
                                 "batch_id long, category string, text string, source_ids array<string>")
    out = {r.pos: r for r in jobs.ingest_responses(resp, script="thai", min_chars=0).collect()}
    assert out[0].reason is None and out[0].question_id == "drill_Math_0000"
    assert out[0].source_question_id == "81"
    assert out[1].reason == "Text does not contain thai characters"
    assert set(out) == {0, 1}                          # non-objects are not drills


def test_score_multiple_choice_micro_f1_is_accuracy(spark):
    preds = spark.createDataFrame([("s", i, r) for i, r in enumerate(
        ["<think>maybe b</think> The answer is a", "c", "I think (d).", "no idea", "e"])],
        "subset string, item_id long, response string")
    golds = spark.createDataFrame([("s", i, g) for i, g in enumerate(["a", "c", "b", "a", "e"])],
                                  "subset string, item_id long, label string")
    rep, mean = jobs.score_multiple_choice(preds, golds)
    r = rep.first()
    assert r.accuracy == pytest.approx(3 / 5) and r.micro_f1 == pytest.approx(r.accuracy)
    assert mean.first().mean_accuracy == pytest.approx(0.6)


def test_score_judged_excludes_errors(spark):
    j = spark.createDataFrame([("q1", 0, "Math", 8), ("q1", 1, "Math", -1), ("q2", 0, "Writing", 6),
                               ("q2", 1, "Writing", 4)], "question_id string, turn int, category string, rating int")
    got = {r.category: r for r in jobs.score_judged(j).collect()}
    assert got["Math"].avg_rating == 8 and got["Math"].n_errors == 1
    assert got["TOTAL"].avg_rating == pytest.approx((8 + 5) / 2)


def test_deduplicate_and_summaries(spark):
    df = spark.createDataFrame([(0, "the same question text here"), (1, "the same question text here!"),
                                (2, "something else entirely")], "id long, q string")
    kept, summary = jobs.deduplicate(df, "q", "id")
    assert sorted(r.id for r in kept.collect()) == [0, 2]
    assert summary.first().n_removed == 1
    m = jobs.score_summaries(spark.createDataFrame([("a b c d", "a b c d")], "hyp string, ref string"))
    assert m.first().bleu == pytest.approx(100.0)


def test_usage_report_total_row(spark):
    calls = spark.createDataFrame([("x", "gpt-4o", 10, 5, 15, False), ("x", "unknown", 0, 0, 0, True)],
                                  "category string, model string, prompt_tokens long, "
                                  "completion_tokens long, total_tokens long, is_cached boolean")
    got = {r.category: r for r in jobs.usage_report(calls).collect()}
    assert got["TOTAL"].api_calls == 1 and got["TOTAL"].cached_calls == 1
    assert got["x"].cost_usd == round(10 / 1e6 * 5 + 5 / 1e6 * 15, 4)


def test_translate_dataset_resume_and_merge(spark):
    entries = spark.createDataFrame([(1, ["hi", "yo"]), (2, ["bad"]), (3, ["x"])], "id long, turns array<string>")
    done = spark.createDataFrame([(3, ["[th] x"], "ok")], "id long, turns array<string>, status string")
    resp = spark.createDataFrame([(1, "turns", 0, None, " [th] hi "), (1, "turns", 1, "Error code: 500", None),
                                  (2, "turns", 0, "content_filter hit", None)],
                                 "id long, field string, pos int, error string, content string")
    out, audit = jobs.translate_dataset(entries, "id", ["turns"], resp, done)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {1, 3} and got[1].status == "failed" and got[1].turns == ["[th] hi", "yo"]
    assert sorted((r.id, r.status) for r in audit.collect()) == [(1, "failed"), (2, "skipped")]


def test_translate_dataset_keeps_rows_and_columns(spark):
    """Pending units, entries without units, scalar, map and nested fields."""
    rows = [(1, "q one", {"a": "x", "b": "y"}, ("a", "why"), "keep"), (2, "q two", {}, None, "me"), (3, "q three", None, ("b", None), "too")]
    entries = spark.createDataFrame(rows, "id long, question string, choices map<string,string>, "
                                          "answer struct<label:string,explanation:string>, note string")
    resp = spark.createDataFrame([(1, "question", 0, None, "Q1"), (1, "choices", 0, None, "X"), (1, "choices", 1, None, "Y"),
                                  (1, "answer.explanation", 0, None, "WHY"), (2, "question", 0, None, "Q2")],
                                 "id long, field string, pos int, error string, content string")
    fields = ["question", "choices", "answer.explanation"]
    out, audit = jobs.translate_dataset(entries, "id", fields, resp)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1].note == "keep" and got[2].choices == {} and got[2].answer is None
    assert (got[1].question, got[1].choices, got[1].answer.label, got[1].answer.explanation) == ("Q1", {"a": "X", "b": "Y"}, "a", "WHY")
    assert [(r.id, r.status, r.n_translated) for r in audit.collect()] == [(3, "pending", 0)]
    empty = spark.createDataFrame([(9, [], "n")], "id long, turns array<string>, note string")
    none = spark.createDataFrame([], "id long, field string, pos int, error string, content string")
    out, _ = jobs.translate_dataset(empty, "id", ["turns"], none)
    assert [(r.id, r.status, r.note, r.n_units) for r in out.collect()] == [(9, "ok", "n", 0)]


def test_short_texts_and_smoothing(spark):
    score = lambda h, r: jobs.score_summaries(spark.createDataFrame([(h, r)], "hyp string, ref string")).first()
    assert score("a b c d e", "a b c x e").sacrebleu == pytest.approx(42.728701, abs=1e-5)
    assert score("a b", "a b").sacrebleu == 0.0 and score("a b", "a b").bleu == 0.0
    assert score("The Cat", "the cat").meteor == pytest.approx(100 * (1 - 0.5 * (1 / 2) ** 3))


def test_ids_go_on_after_existing_rows(spark):
    text = '[{"turns": ["What is a river, please?", "And what is a lake, please?"], "reference": ["a", "b"]}]'
    resp = spark.createDataFrame([(1, "Math", text, ["s1"]), (2, "Math", text, ["s2"])],
                                 "batch_id long, category string, text string, source_ids array<string>")
    first = jobs.ingest_responses(resp, script="english")
    again = jobs.ingest_responses(resp, script="english", existing=first)
    ids = [r.question_id for r in first.collect()] + [r.question_id for r in again.collect()]
    assert len(set(ids)) == 4


def test_package_reaches_workers(spark):
    from weft.session import ship_package
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.parallelize([1], 1).map(lambda _: __import__("weft").__name__).collect() == ["weft"]
