"""Driver queries: translation (K5) and type repair (K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import jsonx
from weft.functions.text import category_match_key, first_turn
from weft.operators import translate as TR
from weft.operators.validate import OPEN_ENDED
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS, norm_cat, strip_sql

# Simulated response outcomes by unit code (code = (7 id + 3 pos
# + field) mod 23); everything else is a successful translation.
OUTCOMES = {
    0: "Error code: 400 - content_filter: the response was filtered",
    1: "Error code: 429 - Rate limit exceeded. Please retry after 17 seconds.",
    2: "Error code: 500 - Internal server error",
    3: "Error code: 404 - Resource not found",
    4: "Request timed out",
}
NULL_CONTENT_CODE = 5


def _units(spark, sf):
    d = bindings.drills(spark, sf)
    return TR.explode_units(d, "conv_id", ["turns", "reference"])


def _responses(units):
    code = F.pmod(F.col("conv_id") * 7 + F.col("pos") * 3
                  + F.when(F.col("field") == "turns", 0).otherwise(1), F.lit(23))
    err = F.lit(None).cast("string")
    for k in sorted(OUTCOMES, reverse=True):
        err = F.when(code == k, F.lit(OUTCOMES[k])).otherwise(err)
    content = F.when(code < len(OUTCOMES), F.lit(None)).when(code == NULL_CONTENT_CODE, F.lit(None)) \
               .otherwise(F.concat(F.lit("  [th] "), F.col("text"), F.lit("\n")))
    return units.select("conv_id", "field", "pos", err.alias("error"), content.alias("content"))


_CODE = "(conv_id * 7 + pos * 3 + CASE WHEN field = 'turns' THEN 0 ELSE 1 END) % 23"
_ERR = "CASE " + " ".join(f"WHEN {_CODE} = {k} THEN '{v}'" for k, v in OUTCOMES.items()) + " END"
_UNITS = f"""
{DRILLS},
u AS (SELECT conv_id, 'turns' AS field, i - 1 AS pos, turns[i] AS text FROM
        (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS i FROM drills)
      UNION ALL
      SELECT conv_id, 'reference', i - 1, reference[i] FROM
        (SELECT conv_id, reference, unnest(range(1, len(reference) + 1)) AS i FROM drills)),
r AS (SELECT *, {_ERR} AS error,
             CASE WHEN {_CODE} < {len(OUTCOMES)} OR {_CODE} = {NULL_CONTENT_CODE} THEN NULL
                  ELSE '  [th] ' || text || chr(10) END AS content FROM u),
s AS (SELECT *, CASE WHEN lower(coalesce(error, '')) LIKE '%content_filter%'
                       OR lower(coalesce(error, '')) LIKE '%content management policy%'
                       OR lower(coalesce(error, '')) LIKE '%responsibleaipolicyviolation%' THEN 'skipped'
                     WHEN error IS NOT NULL THEN 'failed' ELSE 'ok' END AS unit_status FROM r),
o AS (SELECT *, CASE WHEN unit_status = 'ok' AND content IS NOT NULL THEN {strip_sql('content')}
                     ELSE text END AS out_text FROM s)"""


@query("translate_assemble", sql=f"""
WITH {_UNITS},
e AS (SELECT conv_id,
        CASE WHEN max(CASE WHEN unit_status = 'skipped' THEN 1 ELSE 0 END) = 1 THEN 'skipped'
             WHEN max(CASE WHEN unit_status = 'failed' THEN 1 ELSE 0 END) = 1 THEN 'failed'
             ELSE 'ok' END AS status,
        count(field) AS n_units, count_if(unit_status = 'ok') AS n_translated,
        coalesce(list(out_text ORDER BY pos) FILTER (WHERE field = 'turns'), []) AS turns,
        coalesce(list(out_text ORDER BY pos) FILTER (WHERE field = 'reference'), []) AS reference
      FROM (SELECT conv_id FROM drills) d LEFT JOIN o USING (conv_id) GROUP BY conv_id)
SELECT conv_id, status, n_units, n_translated,
       md5(array_to_string(turns, chr(10))) AS turns_md5,
       md5(array_to_string(reference, chr(10))) AS reference_md5
FROM e WHERE status <> 'skipped'
""")
def translate_assemble(spark, sf):
    """P30 + J5 + U4 + F7: translated entries (content-filtered ones are
    dropped to the audit side; failed ones keep their original text)."""
    d = bindings.drills(spark, sf)
    units = TR.explode_units(d, "conv_id", ["turns", "reference"])
    out = TR.apply_responses(units, _responses(units), ["conv_id", "field", "pos"])
    a = TR.assemble(d, out, "conv_id", ["turns", "reference"])
    return a.where(F.col("status") != "skipped").select(
        "conv_id", "status", "n_units", "n_translated",
        F.md5(F.array_join("turns", "\n")).alias("turns_md5"),
        F.md5(F.array_join("reference", "\n")).alias("reference_md5"))


@query("translate_status", sql=f"""
WITH {_UNITS},
e AS (SELECT conv_id,
        CASE WHEN max(CASE WHEN unit_status = 'skipped' THEN 1 ELSE 0 END) = 1 THEN 'skipped'
             WHEN max(CASE WHEN unit_status = 'failed' THEN 1 ELSE 0 END) = 1 THEN 'failed'
             ELSE 'ok' END AS status FROM o GROUP BY conv_id),
w AS (SELECT *, regexp_extract(lower(error), 'retry after (\\d+)', 1) AS s FROM o WHERE unit_status = 'failed')
SELECT 'status' AS kind, status AS key, count(*) AS n, CAST(NULL AS BIGINT) AS wait_s FROM e GROUP BY status
UNION ALL SELECT 'total', 'entries', count(*), NULL FROM e
UNION ALL
SELECT 'error_type', CASE WHEN error LIKE '%429%' THEN 'Rate Limit (429)'
                          WHEN error LIKE '%400%' THEN 'Bad Request (400)'
                          WHEN error LIKE '%404%' THEN 'Resource Not Found (404)'
                          WHEN error LIKE '%500%' THEN 'Server Error (500)' ELSE 'Other' END,
       count(*), CAST(sum(CASE WHEN error LIKE '%429%' OR lower(error) LIKE '%rate limit%'
                               THEN least(greatest(CASE WHEN s = '' THEN 35 ELSE CAST(s AS BIGINT) END, 4), 120)
                               ELSE 4 END) AS BIGINT)
FROM w GROUP BY 2
""")
def translate_status(spark, sf):
    """A17 run summary (per status + total) and A16 error-type histogram with
    P29 suggested waits (last attempt)."""
    units = _units(spark, sf)
    out = TR.apply_responses(units, _responses(units), ["conv_id", "field", "pos"])
    ent = out.groupBy("conv_id").agg(TR.entry_status(F.col("unit_status")).alias("status"))
    st = ent.groupBy(F.col("status").alias("key")).agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit("status").alias("kind"), "key", "n", F.lit(None).cast("bigint").alias("wait_s"))
    tot = ent.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("kind"), F.lit("entries").alias("key"), "n",
        F.lit(None).cast("bigint").alias("wait_s"))
    er = TR.error_report(out).select(F.lit("error_type").alias("kind"), "key", "n", "wait_s")
    return st.unionByName(tot).unionByName(er)


# ---- the whole job, in two runs under one commit log -------------------------

LATE_CODE = 6                   # units with this code are answered in the second run alone


@query("translate_run", sql=f"""
WITH {_UNITS},
z AS (SELECT *, {_CODE} = {LATE_CODE} AS late_ FROM o),
e AS (SELECT conv_id, CASE WHEN bool_or(unit_status = 'skipped') THEN 'skipped' WHEN bool_or(unit_status = 'failed') THEN 'failed'
                           ELSE 'ok' END AS status,
        coalesce(bool_or(late_), false) AS late_,
        array_to_string(coalesce(list(out_text ORDER BY pos) FILTER (WHERE field = 'turns'), []), chr(10)) AS turns2,
        array_to_string(coalesce(list(CASE WHEN late_ THEN text ELSE out_text END ORDER BY pos) FILTER (WHERE field = 'turns'), []), chr(10)) AS turns1,
        array_to_string(coalesce(list(text ORDER BY pos) FILTER (WHERE field = 'turns'), []), chr(10)) AS was
      FROM (SELECT conv_id FROM drills) x LEFT JOIN z USING (conv_id) GROUP BY conv_id),
b AS (SELECT *, CASE WHEN late_ AND status = 'ok' THEN 'run 2' ELSE 'run 1' END AS run_id,
             CASE WHEN late_ AND status = 'ok' THEN turns2 ELSE turns1 END AS turns FROM e),
t AS (SELECT run_id, status FROM b UNION ALL SELECT 'run 1' AS run_id, 'pending' AS status FROM b WHERE run_id = 'run 2')
SELECT 'output' AS sink, run_id, conv_id, status, md5(turns) AS detail, CAST(NULL AS BIGINT) AS n FROM b WHERE status <> 'skipped'
UNION ALL SELECT 'skipped', run_id, conv_id, NULL, md5(was), NULL FROM b WHERE status = 'skipped'
UNION ALL SELECT 'failed', run_id, conv_id, field || ' ' || pos, md5(error || '|' || text), NULL
          FROM o JOIN b USING (conv_id) WHERE unit_status = 'failed' AND status = 'failed'
UNION ALL SELECT 'summary', run_id, NULL, status, NULL, count(*) FROM t GROUP BY run_id, status
UNION ALL SELECT 'summary', run_id, NULL, 'total', NULL, count(*) FROM t GROUP BY run_id
""")
def translate_run(spark, sf):
    """K5 whole (J1, P30, J5, F7, U4, U5, S9, S11, A17): a first run for which
    some answers are missing, the same run again (nothing happens), and a second
    run that takes up the rest; the four sinks are read back from the commits."""
    from weft.plans.jobs import translate_run as run
    from weft.session import scratch_path
    from weft.sources.commits import CommitLog
    log = CommitLog(spark, scratch_path(spark, "translate-log"))
    entries = bindings.drills(spark, sf).drop("system")
    answers = _responses(_units(spark, sf))
    code = F.pmod(F.col("conv_id") * 7 + F.col("pos") * 3 + F.when(F.col("field") == "turns", 0).otherwise(1), F.lit(23))
    early = answers.where(code != LATE_CODE)
    for name, given in (("run 1", early), ("run 1", answers), ("run 2", answers)):
        run(log, name, entries, "conv_id", ["turns", "reference"], given)
    text = lambda *c: F.md5(F.concat_ws("|", *c)).alias("detail")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    turns = F.array_join("turns", "\n")
    return (log.read("output").select(F.lit("output").alias("sink"), "run_id", "conv_id", "status", text(turns), none("long", "n"))
            .unionByName(log.read("skipped").select(F.lit("skipped").alias("sink"), "run_id", "conv_id", none("string", "status"),
                                                    text(turns), none("long", "n")))
            .unionByName(log.read("failed").select(F.lit("failed").alias("sink"), "run_id", "conv_id",
                                                   F.concat_ws(" ", "field", F.col("pos").cast("string")).alias("status"),
                                                   text("error", "failed_text"), none("long", "n")))
            .unionByName(log.read("summary").select(F.lit("summary").alias("sink"), "run_id", none("long", "conv_id"), "status",
                                                    none("string", "detail"), "n")))


# ---- exam items: a string, a map and a nested field --------------------------

_EXAM_FIELDS = ["question", "choices", "answer.explanation"]
NO_RESPONSE_CODES = (6, 7)


def _exam_entries(spark, sf):
    x = bindings.exam(spark, sf)
    letters = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in "abcde"])
    choices = F.map_from_entries(F.filter(letters, lambda e: e["v"].isNotNull()))
    why = F.when(F.pmod("item_id", F.lit(11)) != 0, F.concat(F.lit("because "), F.col("b")))
    return x.select("item_id", "subset", "question", choices.alias("choices"),
                    F.struct(F.col("answer").alias("label"), why.alias("explanation")).alias("answer"))


def _exam_responses(units):
    """Stored twice for some units: the later row counts.  None for others."""
    n = F.when(F.col("field") == "question", 0).when(F.col("field") == "choices", 1).otherwise(2)
    code = F.pmod(F.col("item_id") * 7 + F.col("pos") * 3 + n, F.lit(23))
    err = F.lit(None).cast("string")
    for k in sorted(OUTCOMES, reverse=True):
        err = F.when(code == k, F.lit(OUTCOMES[k])).otherwise(err)
    good = F.when(err.isNull(), F.concat(F.lit(" [th] "), F.col("text"), F.lit("\n")))
    now = units.filter(~code.isin(*NO_RESPONSE_CODES)).select(
        "item_id", "field", "pos", F.lit(2).alias("written"), good.alias("content"), err.alias("error"))
    stale = now.filter(F.pmod("item_id", F.lit(3)) == 0).select(
        "item_id", "field", "pos", F.lit(1).alias("written"), F.lit("stale").alias("content"), F.lit(None).cast("string").alias("error"))
    return now.unionByName(stale)


def _exam_run(spark, sf):
    entries = _exam_entries(spark, sf)
    units = TR.explode_units(entries, "item_id", _EXAM_FIELDS)
    out = TR.apply_responses(units, _exam_responses(units), ["item_id", "field", "pos"], order_col="written")
    return TR.assemble(entries, out, "item_id", _EXAM_FIELDS)


def _sql_errors(code: str) -> str:
    return "CASE " + " ".join(f"WHEN {code} = {k} THEN '{v}'" for k, v in OUTCOMES.items()) + " END"


_EXAM_UNITS = f"""
x AS (SELECT p_partkey AS item_id, string_split(p_type, ' ')[1] AS subset, p_name AS question,
        p_brand AS a, p_type AS b, 'size ' || p_size AS c, 'part ' || p_partkey AS d,
        CASE WHEN p_size % 10 <> 0 THEN 'brand ' || upper(p_brand) END AS e,
        CASE WHEN p_partkey % 11 <> 0 THEN 'because ' || p_type END AS why FROM part),
u AS (SELECT item_id, 'question' AS field, 0 AS n, 0 AS pos, question AS text FROM x
      UNION ALL SELECT item_id, 'choices', 1, 0, a FROM x UNION ALL SELECT item_id, 'choices', 1, 1, b FROM x
      UNION ALL SELECT item_id, 'choices', 1, 2, c FROM x UNION ALL SELECT item_id, 'choices', 1, 3, d FROM x
      UNION ALL SELECT item_id, 'choices', 1, 4, e FROM x WHERE e IS NOT NULL
      UNION ALL SELECT item_id, 'explanation', 2, 0, why FROM x WHERE why IS NOT NULL),
k AS (SELECT *, (item_id * 7 + pos * 3 + n) % 23 AS code FROM u),
s AS (SELECT *, {_sql_errors('code')} AS error,
        CASE WHEN code IN {NO_RESPONSE_CODES} THEN 'pending' WHEN code = 0 THEN 'skipped'
             WHEN code < {len(OUTCOMES)} THEN 'failed' ELSE 'ok' END AS unit_status FROM k),
o AS (SELECT *, CASE WHEN unit_status = 'ok' THEN {strip_sql("' [th] ' || text || chr(10)")} ELSE text END AS out_text FROM s),
g AS (SELECT item_id, CASE WHEN bool_or(unit_status = 'skipped') THEN 'skipped' WHEN bool_or(unit_status = 'failed') THEN 'failed'
                           WHEN bool_or(unit_status = 'pending') THEN 'pending' ELSE 'ok' END AS status,
        count(*) AS n_units, count_if(unit_status = 'ok') AS n_translated,
        max(out_text) FILTER (WHERE field = 'question') AS question,
        array_to_string(list(chr(97 + pos) || '=' || out_text ORDER BY pos) FILTER (WHERE field = 'choices'), '|') AS choices,
        max(out_text) FILTER (WHERE field = 'explanation') AS explanation
      FROM o GROUP BY item_id)"""


@query("translate_exam", sql=f"""
WITH {_EXAM_UNITS}
SELECT g.item_id, x.subset, status, n_units, n_translated, g.question, choices, explanation
FROM g JOIN x USING (item_id) WHERE status IN ('ok', 'failed')
""")
def translate_exam(spark, sf):
    """P30 for exam items: string, map and nested fields, all other columns
    kept; the last stored response counts, pending items stay out."""
    a = _exam_run(spark, sf).where(F.col("status").isin("ok", "failed"))
    pairs = F.transform(F.array_sort(F.map_entries("choices")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return a.select("item_id", "subset", "status", "n_units", "n_translated", "question",
                    F.array_join(pairs, "|").alias("choices"), F.col("answer.explanation").alias("explanation"))


@query("translate_audit", sql=f"""
WITH {_EXAM_UNITS}
SELECT subset, status, count(*) AS n, CAST(sum(n_units - n_translated) AS BIGINT) AS n_open
FROM g JOIN x USING (item_id) WHERE status <> 'ok' GROUP BY subset, status
""")
def translate_audit(spark, sf):
    """S11 + A17: skipped, failed and pending entries, by subset."""
    return _exam_run(spark, sf).where(F.col("status") != "ok").groupBy("subset", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_units") - F.col("n_translated")).alias("n_open"))


# ---- K3 type repair ----------------------------------------------------------

def _drill_lines(spark, sf):
    """Generated drill records as JSON text with the unions the repair handles:
    closed references may hold a list element, open-ended ones are lists of
    lists (some with a null first), and source ids are numbers or strings."""
    d = bindings.drills(spark, sf)
    js = jsonx.json_str
    open_ = category_match_key(F.col("category")).isin(*OPEN_ENDED)

    def lines(x):
        return F.concat(F.lit("["), F.array_join(F.transform(F.split(x, "\n"), js), ", "), F.lit("]"))
    r = F.col("reference")
    closed_ref = F.concat(
        F.lit("["),
        F.array_join(F.transform(r, lambda x, i: F.when(
            (i == 0) & (F.pmod(F.col("conv_id"), F.lit(3)) == 0), lines(x)).otherwise(js(x))), ", "),
        F.lit("]"))
    open_ref = F.concat(F.lit("["), F.array_join(F.transform(
        r, lambda x, i: F.when((i == 0) & (F.pmod(F.col("conv_id"), F.lit(5)) == 0), F.lit("null"))
                         .otherwise(F.concat(F.lit("["), lines(x), F.lit("]")))), ", "),
        F.lit("]"))
    m = F.pmod(F.col("conv_id"), F.lit(4))
    sid = (F.when(m == 0, F.col("conv_id").cast("string"))
            .when(m == 1, F.concat(F.lit('"'), F.col("conv_id").cast("string"), F.lit('"')))
            .when(m == 2, F.lit('"unknown_3"')).otherwise(F.lit('"abc"')))
    line = F.concat(F.lit('{"category": '), js(F.col("category")), F.lit(', "turns": ['),
                    F.array_join(F.transform("turns", js), ", "), F.lit('], "reference": '),
                    F.when(open_, open_ref).otherwise(closed_ref),
                    F.lit(', "source_question_id": '), sid, F.lit("}"))
    return d.select("conv_id", line.alias("line"))


def _repair(lines):
    v = F.try_parse_json(F.col("line"))
    cat = jsonx.get(v, "$.category", "string")
    ref = jsonx.get(v, "$.reference", "array<variant>")
    open_ = category_match_key(cat).isin(*OPEN_ENDED)
    expected = F.when(open_, 3).otherwise(2)
    kind = jsonx.variant_kind

    def numbered(x):   # closed element: list -> "1. x\n2. y\n"
        arr = F.try_variant_get(x, "$", "array<string>")
        return F.when(kind(x) == "ARRAY", F.array_join(F.transform(
            arr, lambda s, i: F.format_string("%d. %s\n", i + 1, s)), "")) \
                .otherwise(F.try_variant_get(x, "$", "string"))

    def bulleted(x):   # open element: list of examples, a list example -> "- x\n- y\n"
        ex = F.try_variant_get(x, "$", "array<variant>")
        return F.array_join(F.transform(ex, lambda e: F.when(
            kind(e) == "ARRAY", F.array_join(F.transform(
                F.try_variant_get(e, "$", "array<string>"),
                lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), ""))
            .otherwise(F.try_variant_get(e, "$", "string"))), "\u001f")
    fixed = F.when(open_, F.transform(ref, bulleted)).otherwise(F.transform(ref, numbered))
    sid = jsonx.get(v, "$.source_question_id", "variant")
    sid_s = F.try_variant_get(sid, "$", "string")
    sid_int = F.when(kind(sid) == "NUMBER", F.try_variant_get(sid, "$", "bigint")) \
               .otherwise(F.coalesce(sid_s.try_cast("bigint"),
                                     F.when(sid_s.contains("unknown"), F.lit(0).cast("bigint"))))
    reason = (F.when(F.size(ref) != expected, F.lit("reference count"))
               .when(F.exists(ref, lambda x: kind(x) == "NULL"), F.lit("null reference"))
               .when(sid_int.isNull(), F.lit("invalid source_question_id")))
    return lines.select(
        "conv_id", F.when(reason.isNull(), "repaired").otherwise("dropped").alias("status"),
        reason.alias("reason"),
        first_turn(jsonx.get(v, "$.turns", "array<string>")).alias("question"),
        F.when(reason.isNull(), F.md5(F.array_join(fixed, "\u001e"))).alias("reference_md5"),
        F.when(reason.isNull(), sid_int).alias("source_question_id"),
        (kind(sid) != "NUMBER").alias("type_changed"))


def _lines_sql(x: str) -> str:
    from weft.plans.q_ingest import _js
    return f"('[' || array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {_js('l')}), ', ') || ']')"


@query("type_repair", sql=f"""
WITH {DRILLS},
d AS (SELECT *, lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') AS open_ FROM drills),
l AS (SELECT conv_id, '{{"category": ' || {__import__('weft.plans.q_ingest', fromlist=['_js'])._js('category')}
        || ', "turns": [' || array_to_string(list_transform(turns, lambda x: {__import__('weft.plans.q_ingest', fromlist=['_js'])._js('x')}), ', ')
        || '], "reference": ' || CASE WHEN open_ THEN
             '[' || array_to_string(list_transform(reference, lambda x, i: CASE WHEN i = 1 AND conv_id % 5 = 0 THEN 'null'
                    ELSE '[' || {_lines_sql('x')} || ']' END), ', ') || ']'
           ELSE '[' || array_to_string(list_transform(reference, lambda x, i: CASE WHEN i = 1 AND conv_id % 3 = 0
                    THEN {_lines_sql('x')} ELSE {__import__('weft.plans.q_ingest', fromlist=['_js'])._js('x')} END), ', ') || ']' END
        || ', "source_question_id": ' || CASE conv_id % 4 WHEN 0 THEN CAST(conv_id AS VARCHAR)
             WHEN 1 THEN '"' || CAST(conv_id AS VARCHAR) || '"' WHEN 2 THEN '"unknown_3"' ELSE '"abc"' END
        || '}}' AS line FROM d),
p AS (SELECT conv_id, line::JSON AS v FROM l),
q AS (SELECT conv_id, v ->> '$.category' AS cat,
        from_json(json_extract(v, '$.reference'), '["JSON"]') AS ref,
        json_extract(v, '$.source_question_id') AS sid,
        from_json(json_extract(v, '$.turns'), '["VARCHAR"]') AS turns FROM p),
r AS (SELECT *, lower({norm_cat('cat')}) IN ('roleplay', 'humanities', 'writing') AS open_,
        CASE WHEN json_type(sid) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(sid AS BIGINT)
             ELSE coalesce(TRY_CAST(sid ->> '$' AS BIGINT), CASE WHEN (sid ->> '$') LIKE '%unknown%' THEN 0 END) END AS sid_int
      FROM q),
f AS (SELECT *, CASE WHEN open_ THEN list_transform(ref, lambda x: array_to_string(list_transform(
                  from_json(x, '["JSON"]'), lambda e: CASE WHEN json_type(e) = 'ARRAY' THEN array_to_string(
                    list_transform(from_json(e, '["VARCHAR"]'), lambda s: '- ' || s || chr(10)), '')
                  ELSE e ->> '$' END), chr(31)))
             ELSE list_transform(ref, lambda x: CASE WHEN json_type(x) = 'ARRAY' THEN array_to_string(
                  list_transform(from_json(x, '["VARCHAR"]'), lambda s, i: CAST(i AS VARCHAR) || '. ' || s || chr(10)), '')
                  ELSE x ->> '$' END) END AS fixed,
        CASE WHEN len(ref) <> CASE WHEN open_ THEN 3 ELSE 2 END THEN 'reference count'
             WHEN len(list_filter(ref, lambda x: x IS NULL)) > 0 THEN 'null reference'
             WHEN sid_int IS NULL THEN 'invalid source_question_id' END AS reason
      FROM r)
SELECT conv_id, CASE WHEN reason IS NULL THEN 'repaired' ELSE 'dropped' END AS status, reason,
  coalesce(turns[1], '') AS question,
  CASE WHEN reason IS NULL THEN md5(array_to_string(fixed, chr(30))) END AS reference_md5,
  CASE WHEN reason IS NULL THEN sid_int END AS source_question_id,
  json_type(sid) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS type_changed
FROM f
""")
def type_repair(spark, sf):
    """K3: F4 reference count, X11 null element -> drop, P23 list elements
    rendered as numbered / bulleted text, P24 id coercion (``unknown`` -> 0,
    other text rejected), P7 question = first turn, A23 type-change flag.
    Rows keep their input order key (no reverse write)."""
    return _repair(_drill_lines(spark, sf))
