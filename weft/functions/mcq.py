"""Multiple-choice expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import after_think, py_strip

# The English QA template, choice letters, label ids.
QA_TEMPLATE_EN = "Question: [QUESTION]\nChoices: [ANSWER_CHOICES]\nAnswer: [LABEL_CHOICE]"
LETTERS = ("a", "b", "c", "d", "e")
COULD_NOT_ANSWER = 5
LABEL_TO_ID = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4,
               "1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "Could not answer": 5}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wide_to_choices(cols=LETTERS) -> Column:
    """Columns ``a..e`` -> array<struct<letter,text>> of those present."""
    arr = F.array(*[F.struct(F.lit(c).alias("letter"), F.col(c).cast("string").alias("text"))
                    for c in cols])
    return F.filter(arr, lambda x: x["text"].isNotNull())


def list_to_choices(arr) -> Column:
    """P10: list of texts -> lettered structs (``chr(97 + k)``)."""
    return F.transform(_c(arr), lambda t, i: F.struct(F.char(i + 97).alias("letter"),
                                                      t.alias("text")))


def render_choices(choices, sep: str = ". ") -> Column:
    """``a. text`` lines by position (text stripped), newline-joined."""
    return F.array_join(F.transform(_c(choices), lambda x, i: F.concat(
        F.char(i + 97), F.lit(sep), py_strip(x["text"]))), "\n")


def mcq_prompt(question, choices, template: str = QA_TEMPLATE_EN) -> Column:
    """Fill ``[QUESTION]`` (stripped) and ``[ANSWER_CHOICES]``."""
    p = F.replace(F.lit(template), F.lit("[QUESTION]"), py_strip(_c(question)))
    return F.replace(p, F.lit("[ANSWER_CHOICES]"), render_choices(choices))


def letter_lines(choices) -> Column:
    """``a) text`` lines by letter."""
    return F.array_join(F.transform(_c(choices), lambda x: F.concat(
        x["letter"], F.lit(") "), x["text"])), "\n")


def answer_text(choices, label) -> Column:
    """Text of the labelled choice (null when the label is not a choice)."""
    m = F.map_from_arrays(F.transform(_c(choices), lambda x: x["letter"]),
                          F.transform(_c(choices), lambda x: x["text"]))
    return F.try_element_at(m, _c(label))


def label_id(label) -> Column:
    """P25: ``a..e`` / ``1..5`` -> 0..4, ``Could not answer`` -> 5."""
    m = F.create_map(*[x for k, v in LABEL_TO_ID.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(label))


def extract_answer_letter(response) -> Column:
    """P26 (rule-based): last standalone ``a``-``e`` token after the reasoning
    block, lower-cased; none -> ``Could not answer``."""
    toks = F.regexp_extract_all(F.lower(after_think(_c(response))),
                                F.lit(r"[\p{L}\p{N}]+"), 0)
    letters = F.filter(toks, lambda x: x.rlike("^[a-e]$"))
    return F.coalesce(F.try_element_at(letters, F.lit(-1)), F.lit("Could not answer"))


# Fixed value: separator the exam SFT answer uses between explanation and label.
ANSWER_JOIN = " คำตอบ: "


def generated_exam_messages(v) -> tuple[Column, Column, Column]:
    """P12/P13 on a parsed generated exam record (variant):
    choices are an object (``k) v`` lines in key order) or a pre-rendered
    string; the answer is an object (label) or a bare string.  Returns
    (user text, assistant label text, SFT answer ``explanation + ' คำตอบ: ' +
    label`` or null when the answer is not an object)."""
    from weft.functions import jsonx
    ch = jsonx.get(v, "$.choices", "variant")
    ans = jsonx.get(v, "$.answer", "variant")
    m = F.try_variant_get(ch, "$", "map<string,string>")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                     lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    rendered = F.when(jsonx.variant_kind(ch) == "OBJECT", lines) \
                .otherwise(F.try_variant_get(ch, "$", "string"))
    user = F.concat(jsonx.get(v, "$.question", "string"), F.lit("\n"), rendered)
    is_obj = jsonx.variant_kind(ans) == "OBJECT"
    label = F.when(is_obj, F.try_variant_get(ans, "$.label", "string")) \
             .otherwise(F.try_variant_get(ans, "$", "string"))
    sft = F.when(is_obj, F.concat(F.try_variant_get(ans, "$.explanation", "string"),
                                  F.lit(ANSWER_JOIN), F.try_variant_get(ans, "$.label", "string")))
    return user, label, sft
