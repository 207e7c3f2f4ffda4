"""Driver queries: tokens (P31, A20), batch round trip (S12, S13, J2, S16),
response detail (P35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import jsonx
from weft.operators import genmetrics as G
from weft.operators import tokens as TK
from weft.plans.registry import query
from weft.sources.tables import read_table

_TOK = f"regexp_extract_all(coalesce(text, ''), '{G.TOKEN_RE}')"


@query("token_truncate", sql=f"""
WITH t AS (SELECT doc_id, {_TOK} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), {TK.MAX_LEN}) AS BIGINT) AS n_kept,
       CAST({TK.MAX_LEN} - least(len(toks), {TK.MAX_LEN}) AS BIGINT) AS n_pad, len(toks) > {TK.MAX_LEN} AS truncated,
       toks[1:{TK.MAX_LEN}][-1] AS last_kept
FROM t
""")
def token_truncate(spark, sf):
    """Tokenize, truncate to 512, pad; mask = ones then zeros."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    t = TK.truncate_pad(d, "text")
    return t.select("doc_id", "n_tokens", "n_kept", "n_pad", "truncated", "last_kept")


@query("length_stats", sql=f"""
WITH t AS (SELECT lang, len({_TOK}) AS n FROM documents)
SELECT lang, count(*) AS n_docs, round(avg(n), 6) AS avg_tokens, CAST(max(n) AS BIGINT) AS max_tokens,
       round(avg(least(n, {TK.MAX_LEN})), 6) AS avg_kept, count_if(n > {TK.MAX_LEN}) AS n_truncated,
       round(count_if(n > {TK.MAX_LEN}) / count(*), 6) AS truncated_share
FROM t GROUP BY lang
""")
def length_stats(spark, sf):
    """Length distribution, original vs truncated, per language."""
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    return TK.length_stats(TK.truncate_pad(d, "text"), ["lang"])


SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("length_percentiles", sql=f"""
WITH t AS (SELECT lang, len({_TOK}) AS n FROM documents)
SELECT lang, count(*) AS n, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS longest,
       CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90,
       CAST(quantile_disc(n, 0.99) AS BIGINT) AS p99
FROM t GROUP BY lang
""")
def length_percentiles(spark, sf):
    """Percentiles of the token lengths per language, from the histograms of
    two runs (even and odd ids) that are merged."""
    from weft.operators import trainset
    d = TK.truncate_pad(read_table(spark, sf, "documents", ["doc_id", "lang", "text"]), "text")
    runs = [trainset.length_histogram(d.where(F.pmod("doc_id", F.lit(2)) == k), ["lang"], "n_tokens") for k in (0, 1)]
    return trainset.percentiles(trainset.merge_histograms(*runs), ["lang"], SHARES)


# ---- S12 / S13 / J2: batch request export and response import --------------

REQUEST_MODEL = "gpt-4o-mini"
SYSTEM_PROMPT = "Translate the question into Thai."


def batch_requests(spark, sf):
    """One request line per benchmark item."""
    b = read_table(spark, sf, "benchmark", ["item_id", "text"])
    body = F.struct(F.lit(REQUEST_MODEL).alias("model"), F.lit(0.0).alias("temperature"),
                    F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                            F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
                     .alias("messages"))
    req = F.struct(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("custom_id"),
                   F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"),
                   body.alias("body"))
    return b.select(F.to_json(req).alias("value"))


def _response_lines(spark, sf):
    """Responses as the batch API returns them (outer JSON line, inner JSON
    content); every sixth inner payload is cut short, every ninth id is
    unknown to the key table."""
    b = read_table(spark, sf, "benchmark", ["item_id", "text"])
    js = jsonx.json_str
    inner = F.when(F.pmod("item_id", F.lit(6)) == 0,
                   F.expr("substring(_inner, 1, length(_inner) - 3)")).otherwise(F.col("_inner"))
    cid = F.when(F.pmod("item_id", F.lit(9)) == 0, F.concat(F.lit("item-x"), F.col("item_id").cast("string"))) \
           .otherwise(F.concat(F.lit("item-"), F.col("item_id").cast("string")))
    base = b.withColumn("_inner", F.concat(
        F.lit('{"question": '), js(F.col("text")), F.lit(', "choices": ["yes", "no"]}')))
    return base.select(F.concat(F.lit('{"custom_id": '), js(cid),
                                F.lit(', "response": {"body": {"choices": [{"message": {"content": '),
                                js(inner), F.lit("}}]}}}")).alias("value"))


def import_responses(lines, key):
    """S13 + J2 + S16: outer line -> content -> inner payload (bad rows
    skipped) -> answer key by id (inner join: unknown ids are skipped)."""
    v = F.try_parse_json(F.col("value"))
    content = jsonx.get(v, "$.response.body.choices[0].message.content", "string")
    inner = F.try_parse_json(content)
    parsed = lines.select(jsonx.get(v, "$.custom_id", "string").alias("custom_id"),
                          jsonx.get(inner, "$.question", "string").alias("question"),
                          jsonx.get(inner, "$.choices", "array<string>").alias("choices"))
    good = parsed.where(F.col("question").isNotNull())
    return good.join(key, "custom_id").withColumn("split", F.lit("test"))


def _js_sql(x):
    from weft.plans.q_ingest import _js
    return _js(x)


@query("batch_roundtrip", sql=f"""
WITH b AS (SELECT item_id, text,
             '{{"question": ' || {_js_sql('text')} || ', "choices": ["yes", "no"]}}' AS full_inner FROM benchmark),
l AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN 'item-x' || CAST(item_id AS VARCHAR) ELSE 'item-' || CAST(item_id AS VARCHAR) END AS cid,
             CASE WHEN item_id % 6 = 0 THEN substr(full_inner, 1, length(full_inner) - 3) ELSE full_inner END AS inner_json FROM b),
o AS (SELECT '{{"custom_id": ' || {_js_sql('cid')} || ', "response": {{"body": {{"choices": [{{"message": {{"content": '
             || {_js_sql('inner_json')} || '}}}}]}}}}}}' AS value FROM l),
p AS (SELECT value ->> '$.custom_id' AS custom_id, value ->> '$.response.body.choices[0].message.content' AS content FROM o),
q AS (SELECT custom_id, content ->> '$.question' AS question,
             CAST(json_array_length(content, '$.choices') AS BIGINT) AS n_choices FROM p WHERE json_valid(content)),
k AS (SELECT 'item-' || CAST(item_id AS VARCHAR) AS custom_id, chr(CAST(97 + item_id % 5 AS INTEGER)) AS answer FROM benchmark)
SELECT custom_id, md5(question) AS question_md5, n_choices, answer, 'test' AS split
FROM q JOIN k USING (custom_id) WHERE question IS NOT NULL
""")
def batch_roundtrip(spark, sf):
    """S12 -> (external batch run) -> S13 -> J2 -> S16."""
    key = read_table(spark, sf, "benchmark", ["item_id"]).select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("custom_id"),
        F.char(F.pmod("item_id", F.lit(5)) + 97).alias("answer"))
    out = import_responses(_response_lines(spark, sf), key)
    return out.select("custom_id", F.md5("question").alias("question_md5"),
                      F.size("choices").cast("bigint").alias("n_choices"), "answer", "split")


@query("response_detail", sql="""
SELECT event_id, event_type AS prompt, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def response_detail(spark, sf):
    """One row per prompt with the response's keys as columns."""
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    return ev.select("event_id", F.col("event_type").alias("prompt"),
                     F.from_json("props", "k bigint")["k"].alias("k"))
