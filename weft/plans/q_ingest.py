"""Driver queries: batch-response ingest (K2: P22, F3, F1, W1/P2, J3, F2,
A15) and validation with reasons (F1, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import jsonx
from weft.functions.text import normalize_category, question_id
from weft.operators import validate as V
from weft.operators.ordering import row_number_within
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS, EXAM, norm_cat, strip_sql

INGEST_SCRIPT = "english"      # the corpus is Latin-script; the source default is thai

# ---- rendering of model responses (one batch per conversation) -------------


def _responses(spark, sf):
    d = bindings.drills(spark, sf)
    n = F.size("turns")
    ks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    t, r = F.col("turns"), F.col("reference")

    def obj(k):
        return F.concat(
            F.lit('{"drill_number": '), (k + 1).cast("string"), F.lit(', "turns": ['),
            jsonx.json_str(F.element_at(t, k + 1)), F.lit(", "),
            jsonx.json_str(F.coalesce(F.try_element_at(t, k + 2), F.lit(""))),
            F.lit('], "reference": ['),
            jsonx.json_str(F.coalesce(F.try_element_at(r, k + 1), F.lit(""))), F.lit(", "),
            jsonx.json_str(F.coalesce(F.try_element_at(r, k + 2), F.lit(""))), F.lit("]}"))
    objs = F.array_join(F.transform(ks, obj), ", ")
    arr = F.concat(F.lit("["), objs, F.lit("]"))
    head, tail = F.lit("Here are the drills:\n```json\n"), F.lit("\n```")
    e = F.pmod("conv_id", F.lit(7))
    text = (F.when(e == 0, F.lit("Sorry, I cannot help with that."))
             .when(e == 1, F.concat(head, F.expr("substring(_arr, 1, length(_arr) - 2)"), tail))
             .when(e == 2, F.concat(head, F.lit('["note", null, '), objs, F.lit("]"), tail))
             .otherwise(F.concat(head, arr, tail)))
    return d.withColumn("_arr", arr).select("conv_id", "category", "turns", text.alias("text"))


def _js(x: str) -> str:
    out = x
    for a, b in (("\\", "\\\\"), ('"', '\\"')):
        out = f"replace({out}, '{a}', '{b}')"
    for code, esc in ((10, "\\n"), (13, "\\r"), (9, "\\t"), (8, "\\b"), (12, "\\f")):
        out = f"replace({out}, chr({code}), '{esc}')"
    return f"('\"' || {out} || '\"')"


_OBJ = ("'{\"drill_number\": ' || (k + 1) || ', \"turns\": [' || " + _js("turns[k + 1]")
        + " || ', ' || " + _js("coalesce(turns[k + 2], '')") + " || '], \"reference\": [' || "
        + _js("coalesce(reference[k + 1], '')") + " || ', ' || "
        + _js("coalesce(reference[k + 2], '')") + " || ']}'")
_HEAD = "'Here are the drills:' || chr(10) || '```json' || chr(10)"
_TAIL = "chr(10) || '```'"

_RESP = f"""
{DRILLS},
o AS (SELECT *, array_to_string(list_transform(range(len(turns)), lambda k: {_OBJ}), ', ') AS objs FROM drills),
resp AS (SELECT conv_id, category, turns, CASE conv_id % 7
           WHEN 0 THEN 'Sorry, I cannot help with that.'
           WHEN 1 THEN {_HEAD} || substr('[' || objs || ']', 1, length('[' || objs || ']') - 2) || {_TAIL}
           WHEN 2 THEN {_HEAD} || '["note", null, ' || objs || ']' || {_TAIL}
           ELSE {_HEAD} || '[' || objs || ']' || {_TAIL} END AS text FROM o),
raw AS (SELECT conv_id, category, turns AS src_turns, regexp_extract(text, '(?s)\\[.*\\]') AS raw FROM resp),
arr AS (SELECT conv_id, category, src_turns,
               CASE WHEN raw <> '' AND json_valid(raw) THEN from_json(raw, '["JSON"]') END AS elems FROM raw),
el AS (SELECT conv_id, category, src_turns, elems, unnest(range(len(elems))) AS pos
       FROM arr WHERE elems IS NOT NULL),
e AS (SELECT conv_id, category, src_turns, pos, elems[pos + 1] AS e FROM el)"""


def _elements(spark, sf):
    r = _responses(spark, sf)
    return r.select("conv_id", "category", F.col("turns").alias("src_turns"),
                    F.posexplode(jsonx.extract_json_array("text")).alias("pos", "e"))


@query("json_array_parse", sql=f"""
WITH {_RESP}
SELECT conv_id, CAST(pos AS BIGINT) AS pos, coalesce(json_type(e) = 'OBJECT', false) AS is_object,
  CAST(json_extract(e, '$.drill_number') AS BIGINT) AS drill_number,
  CAST(CASE WHEN json_type(e, '$.turns') = 'ARRAY' THEN json_array_length(e, '$.turns') END AS BIGINT) AS n_turns,
  e ->> '$.turns[0]' AS first_turn
FROM e
""")
def json_array_parse(spark, sf):
    """P22 + F3: JSON array cut out of free text, exploded with element kinds."""
    el = _elements(spark, sf)
    turns = jsonx.get("e", "$.turns", "array<string>")
    return el.select("conv_id", F.col("pos").cast("bigint").alias("pos"),
                     (jsonx.variant_kind("e") == "OBJECT").alias("is_object"),
                     jsonx.get("e", "$.drill_number", "bigint").alias("drill_number"),
                     F.when(turns.isNotNull(), F.size(turns)).cast("bigint").alias("n_turns"),
                     jsonx.get("e", "$.turns[0]", "string").alias("first_turn"))


def _blank_sql(x: str) -> str:
    return f"({x} IS NULL OR {strip_sql(x)} = '')"


_INGEST = f"""
{_RESP},
obj AS (SELECT conv_id, category, src_turns, pos,
          CASE WHEN json_type(e, '$.turns') = 'ARRAY' THEN from_json(json_extract(e, '$.turns'), '["VARCHAR"]') END AS t,
          CASE WHEN json_type(e, '$.reference') = 'ARRAY' THEN json_array_length(e, '$.reference') END AS nref,
          CASE WHEN lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') THEN 3 ELSE 2 END AS exp_ref
        FROM e WHERE json_type(e) = 'OBJECT'),
s AS (SELECT *, CASE
          WHEN nref IS NULL THEN 'missing reference'
          WHEN nref <> exp_ref THEN printf('expected %d references, got %d', exp_ref, nref)
          WHEN t IS NULL THEN 'missing turns'
          WHEN len(t) <> 2 THEN printf('expected 2 turns, got %d', len(t))
          WHEN len(list_filter(t, lambda x: {_blank_sql('x')})) > 0 THEN 'empty turn' END AS s_reason
      FROM obj),
ids AS (SELECT *, CASE WHEN s_reason IS NULL THEN row_number() OVER (
          PARTITION BY s_reason IS NULL, {norm_cat('category')} ORDER BY conv_id, pos) - 1 END AS idx FROM s),
c AS (SELECT *, CASE
          WHEN len(t) <> 2 THEN printf('Expected 2 turns, got %d', len(t))
          WHEN {_blank_sql('t[1]')} THEN 'Turn 1 is empty'
          WHEN {_blank_sql('t[2]')} THEN 'Turn 2 is empty'
          WHEN NOT regexp_matches(array_to_string(t, ' '), '[a-zA-Z]') THEN 'Text does not contain {INGEST_SCRIPT} characters'
          WHEN length(t[1]) < 20 THEN 'Turn 1 is too short'
          WHEN length(t[2]) < 20 THEN 'Turn 2 is too short' END AS c_reason FROM ids),
ing AS (SELECT conv_id, CAST(pos AS BIGINT) AS pos, category,
          coalesce(s_reason, c_reason) IS NULL AS accepted, coalesce(s_reason, c_reason) AS reason,
          CASE WHEN idx IS NOT NULL THEN printf('drill_%s_%04d', {norm_cat('category')}, idx) END AS question_id,
          CASE WHEN pos < len(src_turns) THEN CAST(conv_id * 100 + pos AS VARCHAR)
               ELSE 'unknown_' || CAST(pos AS VARCHAR) END AS source_question_id
        FROM c)"""


def _ingest(spark, sf, number: bool = True):
    """Parsed drills with their reason; ``number=False`` leaves the ids out (and
    with them the numbering's range shuffle and checkpoint)."""
    el = _elements(spark, sf).where(jsonx.variant_kind("e") == "OBJECT")
    t = jsonx.get("e", "$.turns", "array<string>")
    ref = jsonx.get("e", "$.reference", "array<variant>")
    s = el.withColumn("t", t).withColumn(
        "s_reason", V.mtbench_structure_reason(F.col("t"), ref, F.col("category")))
    if number:
        # Only the keys are numbered; the parsed columns don't go through the range shuffle.
        ok = (s.where(F.col("s_reason").isNull())
               .select("conv_id", "pos", "category", normalize_category(F.col("category")).alias("_cat")))
        ids = row_number_within(ok, ["_cat"], ["conv_id", "pos"], out="_rn").select(
            "conv_id", "pos", question_id(F.col("category"), F.col("_rn") - 1).alias("question_id"))
        allr = s.join(ids, ["conv_id", "pos"], "left")
    else:
        allr = s.withColumn("question_id", F.lit(None).cast("string"))
    reason = F.coalesce("s_reason", V.mtbench_content_reason(F.col("t"), INGEST_SCRIPT))
    src = F.when(F.col("pos") < F.size("src_turns"),
                 (F.col("conv_id") * 100 + F.col("pos")).cast("string")) \
           .otherwise(F.concat(F.lit("unknown_"), F.col("pos").cast("string")))
    return allr.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "category",
                       reason.isNull().alias("accepted"), reason.alias("reason"),
                       "question_id", src.alias("source_question_id"))


@query("batch_ingest", sql=f"WITH {_INGEST} SELECT * FROM ing")
def batch_ingest(spark, sf):
    """K2: parsed drills -> structure check -> running ids within category ->
    source id by (batch, position) with ``unknown_{{i}}`` default -> content
    check; one row per drill with its reason."""
    return _ingest(spark, sf)


@query("ingest_yield", sql=f"""
WITH {_INGEST},
req AS (SELECT category, sum(len(turns)) AS n_requested FROM drills GROUP BY category),
acc AS (SELECT category, count_if(accepted) AS n_accepted FROM ing GROUP BY category)
SELECT category, CAST(n_requested AS BIGINT) AS n_requested, coalesce(n_accepted, 0) AS n_accepted,
       round(coalesce(n_accepted, 0) / n_requested, 6) AS yield_rate
FROM req LEFT JOIN acc USING (category)
""")
def ingest_yield(spark, sf):
    """Accepted / requested per category."""
    req = bindings.drills(spark, sf).groupBy("category").agg(
        F.sum(F.size("turns")).cast("bigint").alias("n_requested"))
    acc = _ingest(spark, sf, number=False).groupBy("category").agg(F.count_if("accepted").alias("n_accepted"))
    out = req.join(acc, "category", "left").withColumn(
        "n_accepted", F.coalesce("n_accepted", F.lit(0)).cast("bigint"))
    return out.withColumn("yield_rate", F.round(F.col("n_accepted") / F.col("n_requested"), 6))


@query("validate_reasons", sql=f"""
WITH {EXAM}, {DRILLS},
ex AS (SELECT item_id, question, answer,
              list_filter([CASE WHEN a IS NOT NULL THEN 'a' END, CASE WHEN b IS NOT NULL THEN 'b' END,
                           CASE WHEN c IS NOT NULL THEN 'c' END, CASE WHEN d IS NOT NULL THEN 'd' END,
                           CASE WHEN e IS NOT NULL THEN 'e' END], lambda x: x IS NOT NULL) AS letters FROM exam)
SELECT 'exam' AS kind, item_id AS id, CASE
    WHEN question IS NULL THEN 'missing question'
    WHEN len(letters) <> 5 THEN printf('Expected 5 choices, got %d', len(letters))
    WHEN NOT list_contains(letters, answer) THEN printf('Answer %s is not in choices', coalesce(answer, 'None'))
    WHEN NOT regexp_matches(question, '[a-zA-Z]') THEN 'Text does not contain english characters' END AS reason
FROM ex
UNION ALL
SELECT 'mtbench', conv_id, CASE
    WHEN len(reference) <> CASE WHEN lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') THEN 3 ELSE 2 END
      THEN printf('expected %d references, got %d',
                  CASE WHEN lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') THEN 3 ELSE 2 END, len(reference))
    WHEN len(turns) <> 2 THEN printf('expected 2 turns, got %d', len(turns))
    WHEN len(list_filter(turns, lambda x: {_blank_sql('x')})) > 0 THEN 'empty turn'
    WHEN NOT regexp_matches(array_to_string(turns, ' '), '[a-zA-Z]') THEN 'Text does not contain english characters'
    WHEN length(turns[1]) < 20 THEN 'Turn 1 is too short'
    WHEN length(turns[2]) < 20 THEN 'Turn 2 is too short' END
FROM drills
""")
def validate_reasons(spark, sf):
    """F1 + F2 with reasons: exam items and drills (null reason = valid)."""
    e = bindings.exam(spark, sf)
    ch = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in "abcde"]),
        lambda x: x["v"].isNotNull()))
    ex = e.select(F.lit("exam").alias("kind"), F.col("item_id").alias("id"),
                  V.exam_reason(F.col("question"), ch, F.col("answer"), INGEST_SCRIPT).alias("reason"))
    d = bindings.drills(spark, sf)
    reason = F.coalesce(V.mtbench_structure_reason(F.col("turns"), F.col("reference"), F.col("category")),
                        V.mtbench_content_reason(F.col("turns"), INGEST_SCRIPT))
    mt = d.select(F.lit("mtbench").alias("kind"), F.col("conv_id").alias("id"), reason.alias("reason"))
    return ex.unionByName(mt)


RETRY_BATCH = 5
MIN_BATCH = 3


@query("retry_plan", sql=f"""
WITH {_INGEST},
req AS (SELECT conv_id, category, CAST(unnest(range(len(turns))) AS BIGINT) AS pos FROM drills),
f AS (SELECT req.* FROM req LEFT JOIN (SELECT conv_id, pos FROM ing WHERE accepted) a
        ON a.conv_id = req.conv_id AND a.pos = req.pos WHERE a.conv_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY {norm_cat('category')} ORDER BY conv_id, pos) AS rn FROM f)
SELECT conv_id, pos, category, CAST((rn - 1) // {max(MIN_BATCH, RETRY_BATCH // 2)} AS BIGINT) AS retry_batch FROM r
""")
def retry_plan(spark, sf):
    """J10 + W8: requested positions that were not accepted (anti-join, not the
    tail of the batch) re-batched at half the batch size (floor ``min``)."""
    d = bindings.drills(spark, sf)
    req = d.select("conv_id", "category",
                   F.posexplode("turns").alias("pos", "_t")).drop("_t") \
           .withColumn("pos", F.col("pos").cast("bigint"))
    acc = _ingest(spark, sf, number=False).where("accepted").select("conv_id", "pos")
    failed = req.join(acc, ["conv_id", "pos"], "left_anti") \
                .withColumn("_cat", normalize_category(F.col("category")))
    n = row_number_within(failed, ["_cat"], ["conv_id", "pos"], out="_rn")
    half = max(MIN_BATCH, RETRY_BATCH // 2)
    return n.select("conv_id", "pos", "category",
                    F.floor((F.col("_rn") - 1) / half).cast("bigint").alias("retry_batch"))


@query("source_profile", sql=f"""
WITH {DRILLS}
SELECT count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM drills
""")
def source_profile(spark, sf):
    """Rows and the sorted category set of a source (the set is bounded
    by the number of categories)."""
    d = bindings.drills(spark, sf)
    return d.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
