"""Driver queries: text cleaning, script profile, language tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.langtag import LEXICON, WORD_SPLIT, tag_languages
from weft.plans.registry import query
from weft.sources.tables import read_table

_WS = T.WS_CLASS


def _with_think(conv):
    """The corpus has no reasoning tags: wrap every assistant turn in one."""
    return conv.withColumn("text", F.when(
        F.col("role") == "assistant",
        F.concat(F.lit("<think>step "), F.col("turn").cast("string"),
                 F.lit("\n  plan\n</think>\n"), F.col("text"))).otherwise(F.col("text")))


@query("clean_text", sql=f"""
WITH c AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant'
      THEN '<think>step ' || CAST(turn AS VARCHAR) || chr(10) || '  plan' || chr(10) || '</think>' || chr(10) || text
      ELSE text END AS text
  FROM conversations)
SELECT conv_id, turn,
  trim(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '{_WS}+', ' ', 'g')) AS cleaned,
  string_split(text, '</think>')[-1] AS answer,
  CAST(length(text) AS BIGINT) AS n_chars
FROM c
""")
def clean_text(spark, sf):
    """P3 (drop reasoning block, collapse whitespace) and P4 (after last tag)."""
    conv = _with_think(read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]))
    return conv.select("conv_id", "turn", T.clean_text("text").alias("cleaned"),
                       T.after_think("text").alias("answer"),
                       F.length("text").cast("bigint").alias("n_chars"))


_SCRIPTS = ["thai", "vietnamese", "english", "japanese", "korean", "chinese",
            "indonesian", "tagalog"]


@query("script_profile", sql="SELECT lang, source, count(*) AS n_docs, " + ", ".join(
    f"CAST(count_if(regexp_matches(coalesce(text, ''), '{T.SCRIPT_RANGES[s]}')) AS BIGINT) AS n_{s}"
    for s in _SCRIPTS) + " FROM documents GROUP BY lang, source")
def script_profile(spark, sf):
    """P5: documents per (lang, source) holding each script (count_if per script)."""
    d = read_table(spark, sf, "documents", ["lang", "source", "text"])
    return d.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(T.has_script("text", s)).alias(f"n_{s}") for s in _SCRIPTS])


def _lex_sql(code: str) -> str:
    arr = "[" + ", ".join(f"'{w}'" for w in LEXICON[code]) + "]"
    return (f"CAST(len(list_filter(string_split_regex(lower(coalesce(text, '')), '{WORD_SPLIT}'), "
            f"lambda x: list_contains({arr}, x))) AS BIGINT)")


_codes = sorted(LEXICON)
_best = "greatest(" + ", ".join(f"s_{c}" for c in _codes) + ")"


@query("lang_tag", sql=f"""
WITH s AS (
  SELECT doc_id, lang, text, {", ".join(f"{_lex_sql(c)} AS s_{c}" for c in _codes)}
  FROM documents)
SELECT doc_id, lang,
  CASE WHEN regexp_matches(coalesce(text, ''), '{T.SCRIPT_RANGES["thai"]}') THEN 'th'
       {" ".join(f"WHEN s_{c} = {_best} AND {_best} > 0 THEN '{c}'" for c in _codes)}
       ELSE 'unknown' END AS detected,
  {_best} AS best_score
FROM s
""")
def lang_tag(spark, sf):
    """Detected language per document, next to the given ``lang``."""
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    return tag_languages(d, "doc_id").select("doc_id", "lang", "detected", "best_score")


@query("lang_tag_accuracy", sql=f"""
WITH s AS (
  SELECT lang, text, {", ".join(f"{_lex_sql(c)} AS s_{c}" for c in _codes)} FROM documents),
t AS (
  SELECT lang, CASE WHEN regexp_matches(coalesce(text, ''), '{T.SCRIPT_RANGES["thai"]}') THEN 'th'
       {" ".join(f"WHEN s_{c} = {_best} AND {_best} > 0 THEN '{c}'" for c in _codes)}
       ELSE 'unknown' END AS detected FROM s)
SELECT lang, count(*) AS n_docs, count_if(detected = lang) AS n_correct,
       count_if(detected = 'unknown') AS n_unknown,
       round(count_if(detected = lang) / count(*), 6) AS accuracy
FROM t GROUP BY lang
""")
def lang_tag_accuracy(spark, sf):
    """P6 report: agreement of the tagger with the given language."""
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    t = tag_languages(d, "doc_id")
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("detected") == F.col("lang")).alias("n_correct"),
        F.count_if(F.col("detected") == "unknown").alias("n_unknown"),
        F.round(F.count_if(F.col("detected") == F.col("lang")) / F.count(F.lit(1)), 6)
         .alias("accuracy"))
