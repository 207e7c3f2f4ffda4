"""Driver queries: multiple choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import mcq
from weft.functions.text import WS_CLASS
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import EXAM, strip_sql
from weft.sources.tables import dealt, read_table

_TPL = mcq.QA_TEMPLATE_EN.replace("\n", "' || chr(10) || '")


@query("mcq_render", sql=f"""
WITH {EXAM},
ch AS (SELECT item_id, question, list_filter([a, b, c, d, e], lambda x: x IS NOT NULL) AS texts FROM exam)
SELECT item_id, CAST(len(texts) AS BIGINT) AS n_choices,
  replace(replace('{_TPL}', '[QUESTION]', {strip_sql('question')}), '[ANSWER_CHOICES]',
          array_to_string(list_transform(texts, lambda x, i: chr(CAST(96 + i AS INTEGER)) || '. ' ||
                          regexp_replace(x, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')), chr(10))) AS prompt
FROM ch
""")
def mcq_render(spark, sf):
    """P9 (wide -> present choices) + P8 (template fill)."""
    e = bindings.exam(spark, sf)
    ch = mcq.wide_to_choices()
    return e.select("item_id", F.size(ch).cast("bigint").alias("n_choices"),
                    mcq.mcq_prompt("question", ch).alias("prompt"))


@query("mcq_messages", sql=f"""
WITH {EXAM},
ch AS (SELECT item_id, question, answer,
              list_filter([{{'letter': 'a', 'text': a}}, {{'letter': 'b', 'text': b}},
                           {{'letter': 'c', 'text': c}}, {{'letter': 'd', 'text': d}},
                           {{'letter': 'e', 'text': e}}], lambda x: x.text IS NOT NULL) AS choices
       FROM exam)
SELECT item_id,
  question || chr(10) || array_to_string(list_transform(choices, lambda x: x.letter || ') ' || x.text), chr(10)) AS user_text,
  list_filter(choices, lambda x: x.letter = answer)[1].text AS assistant_text,
  CAST(CASE answer WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3 WHEN 'e' THEN 4 END AS BIGINT) AS label_id
FROM ch
""")
def mcq_messages(spark, sf):
    """P11 (question + ``a) text`` lines -> answer text) and P25 (label id)."""
    e = bindings.exam(spark, sf)
    ch = mcq.wide_to_choices()
    return e.select("item_id",
                    F.concat("question", F.lit("\n"), mcq.letter_lines(ch)).alias("user_text"),
                    mcq.answer_text(ch, "answer").alias("assistant_text"),
                    mcq.label_id("answer").cast("bigint").alias("label_id"))


@query("answer_extract", sql=f"""
WITH r AS (
  SELECT conv_id, turn, text,
         list_filter(regexp_extract_all(lower(string_split(text, '</think>')[-1]), '[\\p{{L}}\\p{{N}}]+'),
                     lambda x: regexp_full_match(x, '[a-e]')) AS letters
  FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, coalesce(letters[-1], 'Could not answer') AS pred_label FROM r)
SELECT conv_id, turn, pred_label,
  CAST(CASE pred_label WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3
       WHEN 'e' THEN 4 ELSE 5 END AS BIGINT) AS pred_id,
  CAST(conv_id % 5 AS BIGINT) AS gold_id,
  CASE pred_label WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3
       WHEN 'e' THEN 4 ELSE 5 END = conv_id % 5 AS correct
FROM p
""")
def answer_extract(spark, sf):
    """P4 + P26 + P25 + J4: answer letter from each assistant response, joined
    with its gold by item id (never by position)."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    r = conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", mcq.extract_answer_letter("text").alias("pred_label"))
    r = r.withColumn("pred_id", F.coalesce(mcq.label_id("pred_label"),
                                           F.lit(mcq.COULD_NOT_ANSWER)).cast("bigint"))
    gold = (conv.select("conv_id").distinct()
                .withColumn("gold_id", F.pmod("conv_id", F.lit(5)).cast("bigint")))
    return (r.join(gold, "conv_id")
             .withColumn("correct", F.col("pred_id") == F.col("gold_id")))


def _generated_exam_lines(spark, sf):
    """Generated exam records as JSON text: every 4th item has pre-rendered
    choices, every 3rd a bare-string answer (the two union shapes)."""
    from weft.functions import jsonx
    # A narrow table whose rows become JSON and are parsed again: many for a file split.
    e = dealt(bindings.exam(spark, sf), "item_id")
    js = jsonx.json_str
    obj = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}": '), js(F.col(c)))) for c in "abcde"]),
        lambda x: x.isNotNull()), ", "), F.lit("}"))
    rendered = js(F.array_join(F.filter(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}) "), F.col(c))) for c in "abcde"]),
        lambda x: x.isNotNull()), "\n"))
    choices = F.when(F.pmod("item_id", F.lit(4)) == 0, rendered).otherwise(obj)
    answer = F.when(F.pmod("item_id", F.lit(3)) == 0, js(F.col("answer"))).otherwise(F.concat(
        F.lit('{"explanation": '), js(F.concat(F.lit("Because "), F.col("b"))),
        F.lit(', "label": '), js(F.col("answer")), F.lit("}")))
    line = F.concat(F.lit('{"question": '), js(F.col("question")), F.lit(', "choices": '), choices,
                    F.lit(', "answer": '), answer, F.lit("}"))
    return e.select("item_id", line.alias("line"))


def _gx_sql() -> str:
    from weft.plans.q_ingest import _js
    obj = ("'{' || array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\": ' || {_js(c)} END" for c in "abcde")
        + "], lambda x: x IS NOT NULL), ', ') || '}'")
    rend = _js("array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN '{c}) ' || {c} END" for c in "abcde")
        + "], lambda x: x IS NOT NULL), chr(10))")
    ans = (f"CASE WHEN item_id % 3 = 0 THEN {_js('answer')} ELSE '{{\"explanation\": ' || "
           f"{_js(chr(39) + 'Because ' + chr(39) + ' || b')} || ', \"label\": ' || {_js('answer')} || '}}' END")
    return f"""
WITH {EXAM},
l AS (SELECT item_id, ('{{"question": ' || {_js('question')} || ', "choices": ' ||
        CASE WHEN item_id % 4 = 0 THEN {rend} ELSE {obj} END || ', "answer": ' || {ans} || '}}')::JSON AS v FROM exam),
p AS (SELECT item_id, v ->> '$.question' AS q, json_extract(v, '$.choices') AS ch, json_extract(v, '$.answer') AS an FROM l),
u AS (SELECT item_id, q || chr(10) || CASE WHEN json_type(ch) = 'OBJECT'
          THEN array_to_string(list_transform(list_sort(json_keys(ch)), lambda k: k || ') ' || (ch ->> ('$.' || k))), chr(10))
          ELSE ch ->> '$' END AS user_text,
        CASE WHEN json_type(an) = 'OBJECT' THEN an ->> '$.label' ELSE an ->> '$' END AS assistant_text,
        CASE WHEN json_type(an) = 'OBJECT' THEN (an ->> '$.explanation') || '{mcq.ANSWER_JOIN}' || (an ->> '$.label') END AS sft_answer
      FROM p)
SELECT item_id, md5(user_text) AS user_md5, assistant_text, sft_answer FROM u"""


@query("exam_generated", sql=_gx_sql())
def exam_generated(spark, sf):
    """P12 (choices dict or text, answer dict or text -> chat) and P13 (SFT
    answer = explanation + ' คำตอบ: ' + label)."""
    v = F.try_parse_json(F.col("line"))
    user, label, sft = mcq.generated_exam_messages(v)
    return _generated_exam_lines(spark, sf).select(
        "item_id", F.md5(user).alias("user_md5"), label.alias("assistant_text"), sft.alias("sft_answer"))
