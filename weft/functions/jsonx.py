"""JSON expressions: Python-compatible string encoding, array extraction from
free text (P22), element explode with kinds (F3), variant field access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes written by Python's json.dumps(ensure_ascii=False).
JSON_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"),
                ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"),
                *((chr(c), f"\\u{c:04x}") for c in range(0x20) if chr(c) not in "\n\r\t\b\f"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_str(c) -> Column:
    """A string as ``json.dumps`` writes it (quotes included)."""
    c = _c(c)
    # The JSON writer agrees but for control characters without a letter of their own.
    quick = F.to_json(F.array(c))
    full = c
    for a, b in JSON_ESCAPES:
        full = F.replace(full, F.lit(a), F.lit(b))
    return F.when(F.rlike(c, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]")), F.concat(F.lit('"'), full, F.lit('"'))) \
            .when(c.isNotNull(), F.substring(quick, F.lit(2), F.length(quick) - 2))


def extract_json_array(text) -> Column:
    """First ``[`` to last ``]`` (dot-all), parsed; null when absent/invalid."""
    raw = F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"(?s)\[.*\]", 0)
    v = F.try_parse_json(F.when(raw != "", raw))
    return F.try_variant_get(v, "$", "array<variant>")


def variant_kind(v) -> Column:
    """Top-level kind of a variant: OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or NULL."""
    s = F.schema_of_variant(_c(v))
    return (F.when(_c(v).isNull() | (s == "VOID"), F.lit("NULL"))
             .when(s.startswith("OBJECT"), F.lit("OBJECT"))
             .when(s.startswith("ARRAY"), F.lit("ARRAY"))
             .when(s == "STRING", F.lit("STRING"))
             .when(s == "BOOLEAN", F.lit("BOOLEAN"))
             .otherwise(F.lit("NUMBER")))


def get(v, path: str, type_: str) -> Column:
    return F.try_variant_get(_c(v), path, type_)
