"""Driver queries: prompt templates (P19, P20, J6, W2) and judge ratings
(P18, P21, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import first_turn, normalize_category
from weft.operators.ordering import row_number_within
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS, norm_cat

# Template table (user-supplied content; these are placeholders).  The
# ``default`` row is the fallback for categories without their own template.
TEMPLATES = {"Writing": "Write a new drill like this one: [INPUT]",
             "Math": "Write a new math drill like this one: [INPUT]",
             "default": "Write a new drill in the same category as: [INPUT]"}
BATCH_TEMPLATE = "Generate {num_to_generate} new questions.\nTargets:\n{targets}\nAnswer as a JSON array."
BATCH_SIZE = 5
# Judge template keys (fixed values) and our placeholder wording.
JUDGE_TEMPLATES = {
    "single-v1": "[Q] {question} [A] {answer}",
    "single-math-v1": "[Q] {question} [REF] {ref_answer_1} [A] {answer}",
    "single-v1-multi-turn": "[Q1] {question_1} [A1] {answer_1} [Q2] {question_2} [A2] {answer_2}",
    "single-math-v1-multi-turn": ("[Q1] {question_1} [REF1] {ref_answer_1} [A1] {answer_1} "
                                  "[Q2] {question_2} [REF2] {ref_answer_2} [A2] {answer_2}"),
}
REFERENCE_CATEGORIES = ("Math", "Reasoning", "Coding")


def _tpl_df(spark):
    return spark.createDataFrame(list(TEMPLATES.items()), "template_name string, template string")


@query("prompt_fill", sql=f"""
WITH {DRILLS},
t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())}) AS t(template_name, template)),
d AS (SELECT conv_id, category, coalesce(turns[1], '') AS q FROM drills)
SELECT conv_id, category, coalesce(t.template_name, 'default') AS template_name,
       md5(replace(coalesce(t.template, (SELECT template FROM t WHERE template_name = 'default')), '[INPUT]', q)) AS prompt_md5
FROM d LEFT JOIN t ON t.template_name = d.category
""")
def prompt_fill(spark, sf):
    """P19 + J6: template by category with fallback to the default template,
    placeholder filled by literal replace.  The template table is
    configuration (bounded), so it is broadcast."""
    d = bindings.drills(spark, sf).select("conv_id", "category", first_turn(F.col("turns")).alias("q"))
    t = F.broadcast(_tpl_df(spark))
    j = d.join(t, d.category == t.template_name, "left")
    tpl = F.coalesce(F.col("template"), F.lit(TEMPLATES["default"]))
    return j.select("conv_id", "category",
                    F.coalesce("template_name", F.lit("default")).alias("template_name"),
                    F.md5(F.replace(tpl, F.lit("[INPUT]"), F.col("q"))).alias("prompt_md5"))


@query("batch_prompt", sql=f"""
WITH {DRILLS},
src AS (SELECT conv_id, {norm_cat('category')} AS category, turns[1] AS q FROM drills WHERE len(turns) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY conv_id) AS rn FROM src),
b AS (SELECT category, (rn - 1) // {BATCH_SIZE} AS batch_id,
             array_to_string(list(CAST(((rn - 1) % {BATCH_SIZE}) + 1 AS VARCHAR) || '. ' || q ORDER BY rn), chr(10)) AS targets,
             count(*) AS n_items FROM r GROUP BY ALL)
SELECT category, CAST(batch_id AS BIGINT) AS batch_id, n_items,
       md5(replace(replace('{BATCH_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{num_to_generate}}', CAST(n_items AS VARCHAR)),
                   '{{targets}}', targets)) AS prompt_md5
FROM b
""")
def batch_prompt(spark, sf):
    """P20 + W2: source questions (items with two turns) numbered in batches
    of five per category and injected at the anchor; ``{num_to_generate}``
    is substituted (X22)."""
    d = bindings.drills(spark, sf).where(F.size("turns") >= 2).select(
        "conv_id", normalize_category(F.col("category")).alias("category"),
        F.element_at("turns", 1).alias("q"))
    n = row_number_within(d, ["category"], ["conv_id"], out="rn")
    n = n.withColumn("batch_id", F.floor((F.col("rn") - 1) / BATCH_SIZE).cast("bigint"))
    line = F.struct("rn", F.concat((F.pmod(F.col("rn") - 1, F.lit(BATCH_SIZE)) + 1).cast("string"),
                                   F.lit(". "), F.col("q")).alias("line"))
    b = n.groupBy("category", "batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
         .alias("targets"), F.count(F.lit(1)).alias("n_items"))
    p = F.replace(F.replace(F.lit(BATCH_TEMPLATE), F.lit("{num_to_generate}"),
                            F.col("n_items").cast("string")), F.lit("{targets}"), F.col("targets"))
    return b.select("category", "batch_id", "n_items", F.md5(p).alias("prompt_md5"))


def _judged(spark, sf):
    """One row per judged turn: template key, filled prompt, rating (derived
    from the response: ``len mod 10 + 1``; ``len mod 17 = 0`` is a judge error).

    The prompt of a later turn holds everything up to it: slot 1 the turns
    before it (line by line), slot 2 the judged one.  Reference answers stand
    for themselves; the template asks whether the question has any."""
    d = bindings.drills(spark, sf).where(F.size("reference") > 0)
    refs = F.when(F.col("category").isin(*REFERENCE_CATEGORIES), F.transform("reference", F.reverse))
    x = d.select("conv_id", "category", "turns", F.col("reference").alias("responses"), refs.alias("refs"),
                 F.posexplode(F.slice("turns", F.lit(1), F.least(F.size("turns"), F.size("reference"))))
                  .alias("turn", "_q"))
    has_ref = F.col("refs").isNotNull()
    key = F.concat(F.when(has_ref, F.lit("single-math-v1")).otherwise(F.lit("single-v1")),
                   F.when(F.col("turn") > 0, F.lit("-multi-turn")).otherwise(F.lit("")))
    tpl = F.create_map(*[x for k, v in JUDGE_TEMPLATES.items() for x in (F.lit(k), F.lit(v))])
    t, r, refs, n = F.col("turns"), F.col("responses"), F.col("refs"), F.col("turn")
    before = lambda a: F.array_join(F.slice(a, F.lit(1), F.greatest(n, F.lit(1))), "\n")
    slots = {"{question}": F.element_at(t, 1), "{answer}": F.element_at(r, 1),
             "{question_1}": before(t), "{question_2}": F.get(t, n),
             "{answer_1}": before(r), "{answer_2}": F.get(r, n),
             "{ref_answer_1}": before(refs), "{ref_answer_2}": F.get(refs, n)}
    p = F.element_at(tpl, key)
    for k, v in slots.items():
        p = F.replace(p, F.lit(k), F.coalesce(v, F.lit("")))
    resp_len = F.length(F.element_at(r, F.col("turn") + 1))
    rating = F.when(F.pmod(resp_len, F.lit(17)) == 0, F.lit(-1)).otherwise(F.pmod(resp_len, F.lit(10)) + 1)
    return x.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "category",
                    key.alias("template_key"), rating.cast("bigint").alias("rating"),
                    F.md5(p).alias("user_prompt_md5"))


_JUDGED_SQL = f"""
{DRILLS},
x AS (SELECT conv_id, category, turns, reference AS responses,
             CASE WHEN category IN {REFERENCE_CATEGORIES} THEN list_transform(reference, lambda y: reverse(y)) END AS refs,
             unnest(range(least(len(turns), len(reference)))) AS turn FROM drills WHERE len(reference) > 0),
k AS (SELECT *, CASE WHEN refs IS NOT NULL THEN 'single-math-v1' ELSE 'single-v1' END
                || CASE WHEN turn > 0 THEN '-multi-turn' ELSE '' END AS template_key FROM x),
tp AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in JUDGE_TEMPLATES.items())}) AS t(template_key, tpl)),
j AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, category, template_key,
        CAST(CASE WHEN length(responses[turn + 1]) % 17 = 0 THEN -1 ELSE length(responses[turn + 1]) % 10 + 1 END AS BIGINT) AS rating,
        md5(replace(replace(replace(replace(replace(replace(replace(replace(tpl,
          '{{question}}', coalesce(turns[1], '')), '{{answer}}', coalesce(responses[1], '')),
          '{{question_1}}', array_to_string(turns[1:greatest(turn, 1)], chr(10))), '{{question_2}}', coalesce(turns[turn + 1], '')),
          '{{answer_1}}', array_to_string(responses[1:greatest(turn, 1)], chr(10))), '{{answer_2}}', coalesce(responses[turn + 1], '')),
          '{{ref_answer_1}}', coalesce(array_to_string(refs[1:greatest(turn, 1)], chr(10)), '')), '{{ref_answer_2}}', coalesce(refs[turn + 1], ''))) AS user_prompt_md5
      FROM k JOIN tp USING (template_key))"""


@query("judge_table", sql=f"WITH {_JUDGED_SQL} SELECT * FROM j")
def judge_table(spark, sf):
    """P21 + P35: judge table (question, turn, category, template, rating, prompt)."""
    return _judged(spark, sf)


@query("judge_ratings", sql=f"""
WITH {_JUDGED_SQL},
c AS (SELECT category, avg(rating) FILTER (WHERE rating <> -1) AS avg_rating,
             count(*) AS n_ratings, count_if(rating = -1) AS n_errors FROM j GROUP BY category)
SELECT category, round(avg_rating, 6) AS avg_rating, n_ratings, n_errors FROM c
UNION ALL SELECT 'TOTAL', round(avg(avg_rating), 6), CAST(sum(n_ratings) AS BIGINT), CAST(sum(n_errors) AS BIGINT) FROM c
""")
def judge_ratings(spark, sf):
    """Mean rating per category (judge errors excluded and counted, X16),
    total = unweighted mean of the category means."""
    j = _judged(spark, sf)
    c = j.groupBy("category").agg(
        F.avg(F.when(F.col("rating") != -1, F.col("rating"))).alias("avg_rating"),
        F.count(F.lit(1)).alias("n_ratings"), F.count_if(F.col("rating") == -1).alias("n_errors"))
    tot = c.agg(F.lit("TOTAL").alias("category"), F.avg("avg_rating").alias("avg_rating"),
                F.sum("n_ratings").cast("bigint").alias("n_ratings"),
                F.sum("n_errors").cast("bigint").alias("n_errors"))
    return c.unionByName(tot).withColumn("avg_rating", F.round("avg_rating", 6))
