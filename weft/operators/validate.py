"""Validation with reasons (F1 structure, F2 content, F4, F5, F6): ordered
``when`` chains producing one ``reject_reason`` column (null = valid).

Semantics are the intended ones where the source is visibly broken (a
content check that never accepts, an unconditional structure reject, a
length rule bound to a dataset name nobody passes, case-sensitive category
compare): see the repository README.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import SCRIPT_RANGES, category_match_key, py_strip

# Open-ended categories (three references) vs closed (two).
OPEN_ENDED = ("roleplay", "humanities", "writing")
MIN_TURN_CHARS = 20
EXAM_CHOICES = 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def expected_reference_count(category) -> Column:
    """3 for open-ended categories, 2 otherwise (case-insensitive)."""
    return F.when(category_match_key(category).isin(*OPEN_ENDED), F.lit(3)).otherwise(F.lit(2))


def _blank(x: Column) -> Column:
    return x.isNull() | (py_strip(x) == "")


def mtbench_structure_reason(turns, reference, category) -> Column:
    """F1 (mtbench): reference present with the expected count, then exactly
    two non-blank string turns.  Category comes from the request (X4)."""
    t, r = _c(turns), _c(reference)
    return (F.when(r.isNull(), F.lit("missing reference"))
             .when(F.size(r) != expected_reference_count(category),
                   F.format_string("expected %d references, got %d",
                                   expected_reference_count(category), F.size(r)))
             .when(t.isNull(), F.lit("missing turns"))
             .when(F.size(t) != 2, F.format_string("expected 2 turns, got %d", F.size(t)))
             .when(F.exists(t, _blank), F.lit("empty turn")))


def mtbench_content_reason(turns, script: str = "thai", min_chars: int = MIN_TURN_CHARS) -> Column:
    """F2 (mtbench family): 2 turns, no empty turn, target script present
    (X1/X6), each turn at least ``min_chars`` long (X2)."""
    t = _c(turns)
    out = F.when(F.size(t) != 2, F.format_string("Expected 2 turns, got %d", F.size(t)))
    for i in (1, 2):
        out = out.when(_blank(F.element_at(t, i)), F.lit(f"Turn {i} is empty"))
    out = out.when(~F.array_join(t, " ").rlike(SCRIPT_RANGES[script]),
                   F.lit(f"Text does not contain {script} characters"))
    for i in (1, 2):
        out = out.when(F.length(F.element_at(t, i)) < min_chars, F.lit(f"Turn {i} is too short"))
    return out


def exam_reason(question, choices, label, script: str = "thai") -> Column:
    """F1 + F2 (exam): question present, five choices, label among them,
    question holds the target script."""
    ch = _c(choices)
    return (F.when(_c(question).isNull(), F.lit("missing question"))
             .when(ch.isNull(), F.lit("missing choices"))
             .when(F.size(ch) != EXAM_CHOICES, F.format_string("Expected 5 choices, got %d", F.size(ch)))
             .when(~F.coalesce(F.map_contains_key(ch, _c(label)), F.lit(False)),
                   F.format_string("Answer %s is not in choices", F.coalesce(_c(label), F.lit("None"))))
             .when(~F.coalesce(_c(question).rlike(SCRIPT_RANGES[script]), F.lit(False)),
                   F.lit(f"Text does not contain {script} characters")))
