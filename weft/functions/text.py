"""Scalar text expressions (all JVM-side, codegen-friendly).

Every function takes and returns ``Column`` objects so it composes inside
``select``/``where`` and never leaves whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source behaviour for identical results).
# Python's ``str.isspace`` set, spelled out so Java and RE2 agree with it:
# TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD .. HAIR SPACE, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE.
WS_CLASS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Script ranges tested by the validator (fixed values, in source order).
# Indonesian and Malay use the Arabic block; Tagalog and Filipino share one.
SCRIPT_RANGES = {
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "vietnamese": r"[\x{1EA0}-\x{1EF9}]",
    "english": r"[a-zA-Z]",
    "japanese": r"[\x{3040}-\x{30FF}]",
    "korean": r"[\x{AC00}-\x{D7AF}]",
    "chinese": r"[\x{4E00}-\x{9FFF}]",
    "indonesian": r"[\x{0600}-\x{06FF}]",
    "malay": r"[\x{0600}-\x{06FF}]",
    "tagalog": r"[\x{1700}-\x{171F}]",
    "filipino": r"[\x{1700}-\x{171F}]",
}

# Error taxonomy (fixed values): first match wins, in this order.
ERROR_TYPES = (("429", "Rate Limit (429)"), ("400", "Bad Request (400)"),
               ("404", "Resource Not Found (404)"), ("500", "Server Error (500)"))
# Content-filter phrases, matched against the lower-cased message.  The third
# phrase is mixed-case in the source, so there it can never match a lowered
# message; we lower it so the intended test holds.
CONTENT_FILTER_PHRASES = ("content_filter", "content management policy",
                          "responsibleaipolicyviolation")
DEFAULT_RETRY_WAIT = 35
MAX_RETRY_WAIT = 120
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_category(c) -> Column:
    """``' III' -> '_III'`` then ``' ' -> '_'``."""
    return F.replace(F.replace(_c(c), F.lit(" III"), F.lit("_III")), F.lit(" "), F.lit("_"))


def category_match_key(c) -> Column:
    """Lower-cased normalised category, used for matching."""
    return F.lower(normalize_category(c))


def question_id(category, index) -> Column:
    """``drill_{cat}_{idx:04d}``; grows past four digits (no truncation)."""
    return F.format_string("drill_%s_%04d", normalize_category(category), _c(index))


def collapse_ws(t) -> Column:
    """Unicode whitespace runs -> one space, then strip (Python ``split``/``strip``)."""
    return F.trim(F.regexp_replace(_c(t), WS_CLASS + "+", " "))


def clean_text(t) -> Column:
    """Drop ``<think>..</think>`` (dot-all, lazy), collapse whitespace, strip."""
    return collapse_ws(F.regexp_replace(_c(t), r"(?s)<think>.*?</think>", ""))


def after_think(t) -> Column:
    """Text after the last ``</think>``; unchanged when absent."""
    return F.substring_index(_c(t), "</think>", -1)


def has_script(t, script: str = "thai") -> Column:
    """P5: true when the text holds a character of ``script``; null/empty -> false."""
    return F.coalesce(_c(t).rlike(SCRIPT_RANGES[script]), F.lit(False))


def first_turn(turns) -> Column:
    """First turn, or ``''`` when turns is missing or empty."""
    return F.coalesce(F.try_element_at(_c(turns), F.lit(1)), F.lit(""))


def error_class(err) -> Column:
    """First HTTP code found in the message (429, 400, 404, 500), else Other."""
    e = F.coalesce(_c(err), F.lit("Unknown"))
    out = F.lit("Other")
    for code, label in reversed(ERROR_TYPES):
        out = F.when(e.contains(code), F.lit(label)).otherwise(out)
    return out


def is_content_filtered(err) -> Column:
    """Content-filter class (any of the three phrases, case-insensitive)."""
    e = F.lower(F.coalesce(_c(err), F.lit("")))
    cond = F.lit(False)
    for p in CONTENT_FILTER_PHRASES:
        cond = cond | e.contains(p)
    return cond


def is_rate_limited(err) -> Column:
    """``429`` in the message or ``rate limit`` in its lower-cased form."""
    e = F.coalesce(_c(err), F.lit(""))
    return e.contains("429") | F.lower(e).contains("rate limit")


def suggested_wait(err, attempt) -> Column:
    """Of a rate limit ``retry after (\\d+)`` else 35, then
    ``min(max(s, 2^attempt), 120)``; of any other error ``2^attempt``."""
    s = F.regexp_extract(F.lower(F.coalesce(_c(err), F.lit(""))), r"retry after (\d+)", 1)
    secs = F.when(s == "", F.lit(DEFAULT_RETRY_WAIT)).otherwise(s.cast("bigint"))
    backoff = F.pow(F.lit(2), _c(attempt)).cast("bigint")
    limited = F.least(F.greatest(secs, backoff), F.lit(MAX_RETRY_WAIT))
    return F.when(is_rate_limited(err), limited).otherwise(backoff).cast("bigint")


def excerpt(t, n: int = 100) -> Column:
    """First ``n`` characters for log lines."""
    return F.substring(_c(t), 1, n)


def py_strip(t) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(t), f"^{WS_CLASS}+|{WS_CLASS}+$", "")
