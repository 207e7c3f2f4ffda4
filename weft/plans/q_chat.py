"""Driver queries: chat formatting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import chat
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS, strip_sql
from weft.sources.tables import read_table

NL = "chr(10)"


@query("chat_history", sql=f"""
SELECT conv_id, turn, role,
  CAST(coalesce(len(list(role || ': ' || text) OVER w), 0) AS BIGINT) AS n_prev,
  md5(coalesce(array_to_string(list(role || ': ' || text) OVER w, {NL}), '')) AS history_md5
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def chat_history(spark, sf):
    """Running history of the previous turns of each conversation.

    The window is keyed by conversation (many small groups), so it spreads
    over all tasks."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    w = (Window.partitionBy("conv_id").orderBy("turn")
               .rowsBetween(Window.unboundedPreceding, -1))
    prev = F.collect_list(F.concat("role", F.lit(": "), "text")).over(w)
    return conv.select("conv_id", "turn", "role", F.size(prev).cast("bigint").alias("n_prev"),
                       F.md5(F.array_join(prev, "\n")).alias("history_md5"))


def _chatml_sql(variant: str) -> str:
    tail = f" || '<|im_start|>assistant' || {NL}" if variant == "generated" else ""
    return f"""
WITH {DRILLS},
x AS (SELECT conv_id, turns, reference, unnest(range(len(turns))) AS n FROM drills
      WHERE len(reference) > 0 AND len(turns) = len(reference)),
p AS (SELECT conv_id, n,
        array_to_string(list_transform(range(n), lambda k:
          '<|im_start|>user' || {NL} || turns[k + 1] || '<|im_end|>' || {NL} ||
          '<|im_start|>assistant' || {NL} || reference[k + 1] || '<|im_end|>' || {NL}), '')
        || '<|im_start|>user' || {NL} || turns[n + 1] || '<|im_end|>' || {NL}{tail} AS prompt,
        reference[n + 1] AS completion FROM x)
SELECT conv_id, CAST(n AS BIGINT) AS n, md5(prompt) AS prompt_md5,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(completion) AS completion_md5 FROM p"""


def _chatml(spark, sf, variant):
    d = bindings.drills(spark, sf)
    d = d.where((F.size("reference") > 0) & (F.size("turns") == F.size("reference")))   # F5/F6
    x = d.select("conv_id", "turns", "reference", F.posexplode("turns").alias("n", "_t"))
    prompt = chat.chatml_prompt("turns", "reference", F.col("n"), variant=variant)
    return x.select("conv_id", F.col("n").cast("bigint").alias("n"),
                    F.md5(prompt).alias("prompt_md5"),
                    F.length(prompt).cast("bigint").alias("prompt_chars"),
                    F.md5(F.element_at("reference", F.col("n") + 1)).alias("completion_md5"))


@query("chatml", sql=_chatml_sql("generated"))
def chatml(spark, sf):
    """P14 + P15 (generated variant): one example per turn with ChatML history."""
    return _chatml(spark, sf, "generated")


@query("chatml_hub", sql=_chatml_sql("hub"))
def chatml_hub(spark, sf):
    """P15 hub variant: history ends after the user turn."""
    return _chatml(spark, sf, "hub")


@query("interleave", sql=f"""
WITH {DRILLS},
k AS (SELECT conv_id, turns, reference, least(len(turns), len(reference)) AS k FROM drills)
SELECT conv_id, len(reference) >= len(turns) AS is_done,
  CAST(2 * k + CASE WHEN k < len(turns) THEN 1 ELSE 0 END AS BIGINT) AS n_messages,
  CASE WHEN k < len(turns) THEN 'user' WHEN k > 0 THEN 'assistant' END AS last_role,
  md5(array_to_string(list_transform(range(k), lambda i:
        'user: ' || turns[i + 1] || {NL} || 'assistant: ' || reference[i + 1]), {NL})
      || CASE WHEN k < len(turns) THEN (CASE WHEN k > 0 THEN {NL} ELSE '' END) || 'user: ' || turns[k + 1]
         ELSE '' END) AS messages_md5
FROM k
""")
def interleave(spark, sf):
    """P18 + F10: answered pairs then the open user turn; done flag."""
    d = bindings.drills(spark, sf)
    msgs = chat.interleave("turns", "reference")
    return d.select("conv_id", (F.size("reference") >= F.size("turns")).alias("is_done"),
                    F.size(msgs).cast("bigint").alias("n_messages"),
                    F.try_element_at(msgs, F.lit(-1))["role"].alias("last_role"),
                    F.md5(chat.render_messages(msgs)).alias("messages_md5"))


REASONING_SYSTEM = "(reasoning system prompt)"


@query("chat_variants", sql=f"""
WITH {DRILLS},
d AS (SELECT conv_id, coalesce(system, '') AS instruction, turns[1] AS inp, reference[1] AS out1,
             reference[-1] AS outn FROM drills WHERE len(turns) > 0 AND len(reference) > 0)
SELECT conv_id, 'instruction' AS kind,
  md5('system: ' || instruction || {NL} || 'user: ' || inp) AS prompt_md5,
  md5('assistant: ' || {strip_sql('out1')}) AS completion_md5,
  CAST(length({strip_sql('out1')}) AS BIGINT) AS completion_chars FROM d
UNION ALL
SELECT conv_id, 'reasoning',
  md5('system: {REASONING_SYSTEM}' || {NL} || 'user: ' || inp),
  md5('assistant: ' || {strip_sql('out1')} || '</think><answer>' || {strip_sql('outn')} || '</answer>'),
  CAST(length({strip_sql('out1')} || '</think><answer>' || {strip_sql('outn')} || '</answer>') AS BIGINT)
FROM d
""")
def chat_variants(spark, sf):
    """P16 instruction rows and P17 reasoning rows (system/user prompt +
    assistant completion), from each conversation's first turns."""
    d = bindings.drills(spark, sf).where((F.size("turns") > 0) & (F.size("reference") > 0))
    d = d.select("conv_id", F.coalesce("system", F.lit("")).alias("instruction"),
                 F.element_at("turns", 1).alias("inp"), F.element_at("reference", 1).alias("out1"),
                 F.element_at("reference", -1).alias("outn"))
    p1, c1 = chat.instruction_conversation(F.col("instruction"), F.col("inp"), F.col("out1"))
    p2, c2 = chat.reasoning_conversation(REASONING_SYSTEM, F.col("inp"), F.col("out1"),
                                         F.col("outn"))

    def shape(kind, p, c):
        return d.select("conv_id", F.lit(kind).alias("kind"),
                        F.md5(chat.render_messages(p)).alias("prompt_md5"),
                        F.md5(chat.render_messages(c)).alias("completion_md5"),
                        F.length(c[0]["content"]).cast("bigint").alias("completion_chars"))
    return shape("instruction", p1, c1).unionByName(shape("reasoning", p2, c2))


SFT_MAX_LEN = 512
SFT_SEED = 42


def _sft_sql() -> str:
    from weft.operators.genmetrics import TOKEN_RE
    base = _chatml_sql("generated")
    head = base[:base.rindex("SELECT conv_id, CAST(n AS BIGINT) AS n")]
    return head + f"""
SELECT conv_id, CAST(n AS BIGINT) AS n,
  CAST(len(regexp_extract_all(prompt || completion || '<|im_end|>' || {NL}, '{TOKEN_RE}')) AS BIGINT) AS n_tokens,
  CAST(least(len(regexp_extract_all(prompt || completion || '<|im_end|>' || {NL}, '{TOKEN_RE}')), {SFT_MAX_LEN}) AS BIGINT) AS n_kept,
  len(regexp_extract_all(prompt || completion || '<|im_end|>' || {NL}, '{TOKEN_RE}')) > {SFT_MAX_LEN} AS truncated,
  CASE WHEN ('0x' || substr(md5('{SFT_SEED}:' || CAST(conv_id AS VARCHAR) || ':' || CAST(n AS VARCHAR)), 1, 8))::BIGINT % 100 < 50
       THEN 'train' ELSE 'test' END AS split
FROM p"""


@query("sft_examples", sql=_sft_sql())
def sft_examples(spark, sf):
    """K6: F5/F6 guards -> P14/P15 multi-turn ChatML examples -> P31 token
    length and truncation to 512 -> O5 seeded split of the examples."""
    from weft.operators import tokens as TK
    d = bindings.drills(spark, sf)
    d = d.where((F.size("reference") > 0) & (F.size("turns") == F.size("reference")))
    x = d.select("conv_id", "turns", "reference", F.posexplode("turns").alias("n", "_t"))
    text = F.concat(chat.chatml_prompt("turns", "reference", F.col("n"), variant="generated"),
                    F.element_at("reference", F.col("n") + 1), F.lit("<|im_end|>\n"))
    ex = x.select("conv_id", F.col("n").cast("bigint").alias("n"), text.alias("text"))
    t = TK.truncate_pad(ex, "text", SFT_MAX_LEN)
    key = F.concat(F.lit(f"{SFT_SEED}:"), F.col("conv_id").cast("string"), F.lit(":"),
                   F.col("n").cast("string"))
    bucket = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return t.select("conv_id", "n", "n_tokens", "n_kept", "truncated",
                    F.when(bucket < 50, "train").otherwise("test").alias("split"))


def _sft_tokens_sql() -> str:
    from weft.operators.genmetrics import TOKEN_RE
    from weft.operators.trainset import FIRST_ID, PAD_ID
    from weft.plans.q_mcq import _gx_sql
    base, exam = _chatml_sql("generated"), _gx_sql()
    head = base[:base.rindex("SELECT conv_id, CAST(n AS BIGINT) AS n")]
    gx = exam[:exam.rindex("SELECT item_id, md5(user_text)")].strip().removeprefix("WITH ").replace("\np AS (", "\ngp AS (").replace("FROM p)", "FROM gp)")
    return head.rstrip() + f""",
{gx},
ex AS (SELECT 'drill-' || conv_id || '-' || n AS example_id, prompt || completion || '<|im_end|>' || {NL} AS text FROM p
       UNION ALL SELECT 'exam-' || item_id, '<|im_start|>user' || {NL} || user_text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}
                        || sft_answer || '<|im_end|>' || {NL} FROM u WHERE user_text IS NOT NULL AND sft_answer IS NOT NULL),
tk AS (SELECT example_id, text, regexp_extract_all(text, '{TOKEN_RE}') AS toks FROM ex),
vc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 + {FIRST_ID} AS id
       FROM (SELECT unnest(toks) AS token FROM tk) GROUP BY token),
fl AS (SELECT example_id, unnest(toks[1:{SFT_MAX_LEN}]) AS token, unnest(range(least(len(toks), {SFT_MAX_LEN}))) AS pos FROM tk),
en AS (SELECT example_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM fl JOIN vc USING (token) GROUP BY example_id)
SELECT example_id, CAST(len(toks) AS BIGINT) AS input_content_original_length,
       CAST({SFT_MAX_LEN} AS BIGINT) AS input_content_truncated_length, md5(text) AS original_md5,
       md5(array_to_string(toks[1:{SFT_MAX_LEN}], ' ')) AS truncated_md5,
       CAST(least(len(toks), {SFT_MAX_LEN}) AS BIGINT) AS n_attended,
       md5(ids || repeat(',{PAD_ID}', {SFT_MAX_LEN} - least(len(toks), {SFT_MAX_LEN})::INT)) AS ids_md5, true AS labels_are_ids
FROM tk JOIN en USING (example_id)"""


@query("sft_tokens", sql=_sft_tokens_sql())
def sft_tokens(spark, sf):
    """K6 whole (F5, F6, P13-P15, U1, P31): drills and generated exam records as
    examples with input_ids, attention_mask, labels and the monitoring columns."""
    from weft.plans.jobs import training_set
    from weft.plans.q_mcq import _generated_exam_lines
    t = training_set(bindings.drills(spark, sf), _generated_exam_lines(spark, sf), SFT_MAX_LEN)
    return t.select(
        "example_id", "input_content_original_length", "input_content_truncated_length", F.md5("input_content_original").alias("original_md5"),
        F.md5("input_content_truncated").alias("truncated_md5"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_attended"),
        F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"),
        (F.col("labels") == F.col("input_ids")).alias("labels_are_ids"))
