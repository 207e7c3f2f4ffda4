"""Language tagging by script and stop-word score (the source falls back
to "unknown" when its detector is unavailable; here a small lexicon scores
each text).

Plan: one pattern for each lexicon (their size is bounded by this file) counts
its words where the row is read: no row per word, no array of words, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import has_script

# Stop-word lexicons (lower case), one per language code.
LEXICON = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "den",
           "dem", "ein", "eine", "sich", "im", "auf", "für", "des"),
    "en": ("the", "and", "of", "to", "is", "was", "that", "it", "with", "as",
           "for", "on", "by", "this", "are", "be", "from", "a"),
    "es": ("el", "los", "las", "del", "y", "que", "es", "una", "por", "con",
           "para", "se", "al", "lo"),
    "fr": ("le", "la", "les", "des", "du", "un", "une", "et", "est", "qui",
           "dans", "pour", "par", "sur", "au", "aux", "avec", "ou"),
}
#: What words are split at: they are the maximal runs of letters.
WORD_SPLIT = r"[^\p{L}]+"


def _hits(text: Column, listed: tuple[str, ...]) -> Column:
    """How many of a text's words are listed."""
    return F.regexp_count(text, F.lit(r"(?<!\p{L})(?:" + "|".join(listed) + r")(?!\p{L})")).cast("bigint")


def lexicon_scores(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """The rows of ``df`` with s_<code>..., word counts per lexicon (rows without
    any hit get zeros)."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.select("*", *[_hits(lowered, LEXICON[c]).alias(f"s_{c}") for c in sorted(LEXICON)])


def tag_languages(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Adds ``detected`` and ``best_score``: Thai script -> ``th``; else the
    lexicon with most hits (ties to the alphabetically first code); no hit ->
    ``unknown``."""
    codes = sorted(LEXICON)
    s = lexicon_scores(df, id_col, text)
    best = F.greatest(*[F.col(f"s_{c}") for c in codes])
    pick = F.lit("unknown")
    for code in reversed(codes):
        pick = F.when((F.col(f"s_{code}") == best) & (best > 0), F.lit(code)).otherwise(pick)
    return (s.withColumn("detected", F.when(has_script(text, "thai"), F.lit("th")).otherwise(pick))
             .withColumn("best_score", best)
             .drop(*[f"s_{c}" for c in codes]))
