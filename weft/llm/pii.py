"""Personal data by weak supervision, in DataFrame functions only.

Base spans: four patterns with their checks (e-mail; IP address; card number
with its check digit; phone number), leftmost and non-overlapping per kind.

Added spans: every word with a digit or an @ is a candidate.  Labelers vote on
it, each yes, no or nothing: formats (regex), cue words inside it (gazetteer)
and the text before it (context).  The votes are counted per pattern over the
whole corpus; expectation-maximisation on the pattern counts estimates each
labeler's reliability and each pattern's probability.  These probabilities are
the soft labels of a logistic classifier over the candidate's shape; a candidate
that it accepts, and that touches no base span, is added as a ``secret`` or an
``id``.

Places in a text come from marking matches with two control characters and
splitting there; running sums of the parts' lengths are taken in blocks, so a
text with very many matches costs little more than its length.  Texts that can't
have a kind's match are not searched for it.  All of it is one narrow scan, and
one more for the pattern counts, whose rows (at most 3^labelers times
2^features) are the only ones that reach the driver.

Offsets are code points, end exclusive.  Results: a null text is empty and has
no spans; texts of any length are searched whole; repeated rows are each
searched; other columns are kept; without candidates nothing is added.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds at equal starts.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = KINDS[:4]
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_BLOCK = 256
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns.  Possessive runs and the look-behinds find what the plain
#: patterns find, without their repeated starts within a run.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "@", "phone": "+"}
_GUARD_PATTERNS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}"}
#: A word with a digit or an @.
CANDIDATE = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"


def _matches(df: DataFrame, out: str, pattern: str, guard: Column) -> DataFrame:
    """Adds ``out``: array of (start, m, before) of the pattern's matches in
    ``_t`` (null where the guard is false).  ``before``: up to 32 code points
    between the match and the one before it."""
    clean = F.translate("_t", _OPEN + _CLOSE, _OTHER * 2)
    marked = F.regexp_replace(clean, f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    df = df.withColumn("_p", F.when(guard, F.split(marked, _OPEN)))
    df = df.withColumn("_l", F.transform("_p", lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / _BLOCK).cast("int")),
                         lambda b: total(F.slice(F.col("_l"), b * _BLOCK + 1, F.lit(_BLOCK))))
    df = df.withColumn("_b", F.when(F.size("_l") > 0, blocks))
    df = df.withColumn("_b", F.transform(F.sequence(F.lit(0), F.size("_b") - 1),
                                         lambda b: total(F.slice(F.col("_b"), F.lit(1), b))))

    def one(i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get("_b", block) + total(F.slice(F.col("_l"), block * _BLOCK + 1, i % _BLOCK))
        return F.struct(start.alias("start"), F.substring_index(F.get("_p", i), _CLOSE, 1).alias("m"),
                        F.right(F.substring_index(F.get("_p", i - 1), _CLOSE, -1), F.lit(32)).alias("before"))

    found = F.when(F.size("_p") > 1, F.transform(F.sequence(F.lit(1), F.size("_p") - 1), one))
    return df.withColumn(out, found).drop("_p", "_l", "_b")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "card":
        digits = F.split(F.reverse(F.regexp_replace(m, "[ -]", "")), "")
        values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * (i % 2 + 1))
        luhn = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0
        n = F.length(F.regexp_replace(m, "[ -]", ""))
        return F.when(n.between(12, 19), luhn).otherwise(F.lit(False))
    return F.lit(True)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _t (the text, null as empty) and _base: sorted (start, kind, end)."""
    df = docs.withColumn("_t", F.coalesce(text_col, F.lit("")))
    for kind, pattern in PATTERNS.items():
        guard = (F.contains("_t", F.lit(_GUARDS[kind])) if kind in _GUARDS
                 else F.rlike("_t", F.lit(_GUARD_PATTERNS[kind])))
        df = _matches(df, f"_{kind}", pattern, guard)
        df = df.withColumn(f"_{kind}", F.coalesce(_checked(kind, F.col(f"_{kind}")), F.array().cast(_SPANS)))
    names = [f"_{k}" for k in BASE]
    return df.withColumn("_base", F.array_sort(F.concat(*names))).drop(*names)


def _checked(kind: str, found: Column) -> Column:
    """The spans of the matches that pass the kind's check."""
    return F.transform(F.filter(found, lambda x: _valid(kind, x["m"])),
                       lambda x: _span(kind, x["start"], x["start"] + F.length(x["m"])))


def _of_kinds(spans: Column, kinds) -> Column:
    """One sorted array of spans per kind; spans of a kind don't overlap."""
    one = lambda k: F.filter(spans, lambda x: x["kind"] == KINDS.index(k))
    return F.array(*map(one, kinds))


def _furthest(by_kind: Column, before: Column) -> Column:
    """The furthest end of the spans that start before a place (0: none): of
    each kind the last such span, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(23, -1, -1)])

    def last_end(spans: Column) -> Column:
        at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(spans, n + step - 1)["start"] < before, n + step).otherwise(n))
        return F.coalesce(F.get(spans, at - 1)["end"], F.lit(0))

    return F.array_max(F.transform(by_kind, last_end))


# -- candidates and labelers ---------------------------------------------------
#: Cue words of credentials, and of contact or account data.
SECRET_CUES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
PERSON_CUES = "e-?mail|mail|phone|tel|telephone|mobile|fax|call|contact|ssn|passport|iban|account|card|credit|ip|address"


def _labelers(c: Column) -> dict[str, Column]:
    """Votes on a candidate (m: its word, before: the text before it):
    true, false or null."""
    m, before = c["m"], c["before"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    yes_no = lambda yes, no: F.when(yes, True).when(no, False)
    return {
        # formats
        "contact_format": yes_no(F.rlike(m, F.lit(rf"^{_LOCAL}+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$|^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$")),
                                 F.rlike(m, F.lit(r"^[0-9]{1,4}$|^[0-9]{1,2}\.[0-9]{1,2}$"))),
        "number_format": yes_no(F.rlike(m, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^[0-9]{12,19}$|^[0-9]{3}-[0-9]{4}$")),
                                digits <= 4),
        "key_format": yes_no(F.rlike(m, F.lit(r"^[A-Z]{4}[A-Z0-9]{16}$|^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{24,}$|=[^=\s]{8,}$")),
                             F.length(m) < 8),
        # gazetteers
        "secret_word": F.when(F.rlike(m, F.lit(rf"(?i)(?:{SECRET_CUES})|^AKIA|^ghp_|^sk-")), True),
        "mail_host": yes_no(F.rlike(m, F.lit(r"(?i)@.*(?:mail|example|gmail|yahoo|outlook|hotmail|proton)[a-z0-9-]*\.")),
                            F.rlike(m, F.lit(r"(?i)^(?:v|version|no|nr|fig|chapter|page)\.?[0-9.]+$"))),
        # context
        "secret_before": yes_no(F.rlike(before, F.lit(rf"(?i)(?:{SECRET_CUES})\s*(?:is)?\s*[:=]?\s*[\"']?$")),
                                F.rlike(before, F.lit(r"(?i)(?:version|chapter|page|section|figure|license,?|cc by-nc)\s*$"))),
        "person_before": yes_no(F.rlike(before, F.lit(rf"(?i)\b(?:{PERSON_CUES})\s*(?:is|at|no\.?|number)?\s*[:=]?\s*$")),
                                F.rlike(before, F.lit(r"(?i)(?:[$€£]|about|over|than)\s*$"))),
    }


def _features(c: Column) -> list[Column]:
    """The candidate's shape, for the final classifier."""
    m = c["m"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return [F.length(m) >= 8, F.length(m) >= 16, digits >= 7, F.contains(m, F.lit("@")), F.rlike(m, F.lit("[=:]")),
            digits * 2 >= F.length(m), F.rlike(m, F.lit("[A-Za-z]")),
            F.rlike(c["before"], F.lit(rf"(?i)(?:{SECRET_CUES}|{PERSON_CUES})\W*$"))]


def _candidates(df: DataFrame) -> DataFrame:
    """Adds _c: (start, m, before) of the candidate words without the quotes,
    brackets and stops around them."""
    df = _matches(df, "_c", CANDIDATE, F.rlike("_t", F.lit("[0-9@]")))
    lead = lambda x: F.length(F.regexp_extract(x["m"], r"^[\"'(\[<{]*", 0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x["m"], r"^[\"'(\[<{]*", ""), r"(?<![\"')\]>},.;:!?])[\"')\]>},.;:!?]+$", "")
    return df.withColumn("_c", F.transform("_c", lambda x: F.struct(
        (x["start"] + lead(x)).alias("start"), bare(x).alias("m"),
        F.concat(x["before"], F.substring(x["m"], F.lit(1), lead(x))).alias("before"))))


def _mask(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)])


def _votes(c: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(v, 2 * 3**k).when(~v, 3**k).otherwise(0)
                                       for k, v in enumerate(_labelers(c).values())])


def em(patterns: dict[int, int], labelers: int, rounds: int = 60) -> tuple[dict[int, float], list[tuple[list[float], list[float]]], float]:
    """Two-class expectation-maximisation on counted vote patterns (base-3
    digits: 0 nothing, 1 no, 2 yes).  Returns each pattern's probability, per
    labeler the vote rates in both classes, and the share of the class."""
    digits = {p: [p // 3**k % 3 for k in range(labelers)] for p in patterns}
    # It starts from the majority of the votes.
    q = {p: (d.count(2) + 0.1) / (d.count(1) + d.count(2) + 0.5) for p, d in digits.items()}
    rates: list[tuple[list[float], list[float]]] = []
    share = 0.5
    for _ in range(rounds):
        n = sum(patterns.values())
        share = (sum(c * q[p] for p, c in patterns.items()) + 1) / (n + 2)
        rates = []
        for k in range(labelers):
            yes, no = [1.0] * 3, [1.0] * 3
            # A vote speaks for its class: a labeler is taken to be better than chance.
            yes[2] += 2
            no[1] += 2
            for p, c in patterns.items():
                yes[digits[p][k]] += c * q[p]
                no[digits[p][k]] += c * (1 - q[p])
            rates.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
        for p, d in digits.items():
            z = math.log(share / (1 - share)) + sum(math.log(rates[k][0][v] / rates[k][1][v]) for k, v in enumerate(d))
            q[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
    return q, rates, share


def fit_classifier(counts: dict[int, tuple[float, float]], features: int, rounds: int = 400) -> list[float]:
    """Logistic regression on counted feature masks: mask -> (rows, sum of
    their probabilities).  Returns weights and, last, the bias."""
    rows = [([m >> k & 1 for k in range(features)] + [1], n, s) for m, (n, s) in counts.items()]
    total = sum(n for _, n, _ in rows) or 1.0
    w = [0.0] * (features + 1)
    for r in range(rounds):
        g = [1e-3 * x for x in w]
        for x, n, s in rows:
            z = sum(a * b for a, b in zip(w, x))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            for k, on in enumerate(x):
                if on:
                    g[k] += (n * p - s) / total
        w = [a - 2.0 * b for a, b in zip(w, g)]
    return w


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """The label model and the span classifier, from the whole corpus."""
    df = _candidates(docs.select(F.coalesce(text_col, F.lit("")).alias("_t")))
    each = df.select(F.explode("_c").alias("c"))
    labelers = len(_labelers(F.col("c")))
    features = len(_features(F.col("c")))
    counted = (each.select(_votes(F.col("c")).alias("v"), _mask(_features(F.col("c"))).alias("f"))
                   .groupBy("v", "f").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns: dict[int, int] = {}
    for r in counted:
        patterns[r.v] = patterns.get(r.v, 0) + r.n
    q, rates, share = em(patterns, labelers)
    masks: dict[int, tuple[float, float]] = {}
    for r in counted:
        n, s = masks.get(r.f, (0.0, 0.0))
        masks[r.f] = n + r.n, s + r.n * q[r.v]
    w = fit_classifier(masks, features) if masks else [0.0] * features + [-1.0]
    accepted = [m for m in range(1 << features)
                if sum(a * (m >> k & 1) for k, a in enumerate(w)) + w[-1] >= 0]
    return {"accepted": accepted if masks else [], "weights": w, "patterns": q, "rates": rates, "share": share}


def find(docs: DataFrame, model: dict, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: sorted (start, kind, end) of base and added spans;
    ``kind`` is a place in KINDS."""
    df = _candidates(base_spans(docs, text_col))
    accepted = F.array(*map(F.lit, model["accepted"])) if model["accepted"] else F.array().cast("array<int>")
    good = F.filter("_c", lambda c: F.array_contains(accepted, _mask(_features(c))) & (F.length(c["m"]) > 0))
    df = df.withColumn("_a", F.transform(good, lambda c: F.struct(
        c["start"].alias("start"),
        F.when(_labelers(c)["secret_word"] | _labelers(c)["secret_before"] | _labelers(c)["key_format"], KINDS.index("secret"))
         .otherwise(KINDS.index("id")).alias("kind"),
        (c["start"] + F.length(c["m"])).alias("end"))))
    # A base span that a candidate touches keeps it out.
    df = df.withColumn("_k", F.when(F.size("_a") > 0, _of_kinds(F.col("_base"), BASE)))
    free = F.filter("_a", lambda a: _furthest(F.col("_k"), a["end"]) <= a["start"])
    return (df.withColumn(out, F.array_sort(F.concat("_base", F.coalesce(free, F.array()).cast(_SPANS))))
              .drop("_t", "_c", "_a", "_k", "_base"))


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def only_base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind"] < len(BASE))


def digest(found: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    s = F.col(spans_col)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(span_string(only_base(s)), 256).alias("base_sha256"),
                        span_string(s).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The text with each run of overlapping spans replaced by the first one's
    kind in brackets; a text without spans isn't touched."""
    s = F.col(spans_col)
    df = found.withColumn("_ch", F.when(F.size(s) > 0, F.split(F.col(text_col), "")))
    df = df.withColumn("_ch", F.filter("_ch", lambda x: x != ""))
    df = df.withColumn("_k", F.when(F.size(s) > 0, _of_kinds(s, KINDS)))
    # A span starts a run if no span before it reaches it; of equal starts the first.
    fresh = F.filter(s, lambda x, i: (_furthest(F.col("_k"), x["start"]) <= x["start"])
                     & ((i == 0) | (F.get(s, i - 1)["start"] < x["start"])))
    df = df.withColumn("_r", F.when(F.size(s) > 0, fresh))
    runs = F.transform("_r", lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), _furthest(
        F.col("_k"), F.coalesce(F.get("_r", i + 1)["start"], F.lit(2**31 - 1))).alias("end")))
    df = df.withColumn("_r", runs)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    end_before = lambda k: F.coalesce(F.get("_r", k - 1)["end"], F.lit(0))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_r")), lambda k: F.concat(
        F.slice(F.col("_ch"), end_before(k) + 1, F.coalesce(F.get("_r", k)["start"], F.size("_ch")) - end_before(k)),
        F.when(k < F.size("_r"), F.array(F.get(names, F.get("_r", k)["kind"]))).otherwise(F.array().cast("array<string>")))))
    text = F.when(F.size(s) > 0, F.array_join(pieces, "")).otherwise(F.col(text_col))
    return df.withColumn(text_col, text).drop("_ch", "_k", "_r")
