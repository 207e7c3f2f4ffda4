"""Driver queries: generation metrics (A9-A14, P33) on document pairs."""

from __future__ import annotations

from weft.functions.text import WS_CLASS
from weft.operators import genmetrics as G
from weft.plans import bindings
from weft.plans.registry import query

TOK = G.TOKEN_RE

_PAIRS = f"""
p AS (SELECT h.doc_id // 2 AS pair_id, h.lang, coalesce(h.text, '') AS hyp, coalesce(r.text, '') AS ref
      FROM documents h JOIN documents r ON r.doc_id = h.doc_id + 1 WHERE h.doc_id % 2 = 0),
t AS (SELECT pair_id, lang, hyp, ref, regexp_extract_all(hyp, '{TOK}') AS ht,
             regexp_extract_all(ref, '{TOK}') AS rt FROM p)"""


def _ngram_counts(side: str, order: int) -> str:
    toks = "ht" if side == "h" else "rt"
    orders = "[" + ", ".join(str(i) for i in range(1, order + 1)) + "]"
    return f"""
{side}o AS (SELECT pair_id, lang, {toks} AS tk, unnest({orders}) AS n FROM t),
{side}g AS (SELECT pair_id, lang, n, array_to_string(tk[i:i + n - 1], ' ') AS g
        FROM (SELECT pair_id, lang, n, tk, unnest(range(1, len(tk) - n + 2)) AS i FROM {side}o)),
{side}c AS (SELECT pair_id, lang, n, g, count(*) AS c FROM {side}g GROUP BY ALL)"""


_MATCH = """
m AS (SELECT hc.pair_id, hc.lang, hc.n, sum(least(hc.c, rc.c)) AS o
      FROM hc JOIN rc ON hc.pair_id = rc.pair_id AND hc.n = rc.n AND hc.g = rc.g GROUP BY ALL)"""

_BLEU_SUMS = f"""
WITH {_PAIRS}, {_ngram_counts('h', 4)}, {_ngram_counts('r', 4)}, {_MATCH},
tot AS (SELECT lang, sum(len(ht)) AS c, sum(len(rt)) AS r, count(*) AS n_pairs,
        {", ".join(f"sum(greatest(len(ht) - {n} + 1, 0)) AS t{n}" for n in range(1, 5))}
        FROM t GROUP BY lang),
mm AS (SELECT lang, {", ".join(f"coalesce(sum(o) FILTER (WHERE n = {n}), 0) AS m{n}" for n in range(1, 5))}
       FROM m GROUP BY lang),
pr AS (SELECT tot.lang, c, r, n_pairs, t1, t2, t3, t4, m1, m2, m3, m4,
        {", ".join(f"CASE WHEN t{n} > 0 THEN coalesce(m{n}, 0) / t{n} ELSE 0.0 END AS p{n}" for n in range(1, 5))}
       FROM tot LEFT JOIN mm USING (lang))"""

_BLEU_SQL = _BLEU_SUMS + """
SELECT lang, round(CASE WHEN least(p1, p2, p3, p4) > 0
    THEN exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0 END
  * (CASE WHEN c > r THEN 1.0 WHEN c > 0 THEN exp(1 - r / c) ELSE 0.0 END) * 100, 6) AS bleu,
  n_pairs
FROM pr"""

# The k-th order without a match counts as 1 / (2^k n-grams); without n-grams the score is 0.
_SACRE_SQL = _BLEU_SUMS + """,
z AS (SELECT *, CASE WHEN coalesce(m1, 0) = 0 THEN 1 ELSE 0 END AS z1, CASE WHEN coalesce(m2, 0) = 0 THEN 1 ELSE 0 END AS z2,
             CASE WHEN coalesce(m3, 0) = 0 THEN 1 ELSE 0 END AS z3, CASE WHEN coalesce(m4, 0) = 0 THEN 1 ELSE 0 END AS z4 FROM pr),
y AS (SELECT *, CASE WHEN z1 = 0 THEN p1 ELSE 1 / (2 ^ z1 * t1) END AS s1, CASE WHEN z2 = 0 THEN p2 ELSE 1 / (2 ^ (z1 + z2) * t2) END AS s2,
             CASE WHEN z3 = 0 THEN p3 ELSE 1 / (2 ^ (z1 + z2 + z3) * t3) END AS s3,
             CASE WHEN z4 = 0 THEN p4 ELSE 1 / (2 ^ (z1 + z2 + z3 + z4) * t4) END AS s4 FROM z)
SELECT lang, round(CASE WHEN t4 > 0 THEN exp((ln(s1) + ln(s2) + ln(s3) + ln(s4)) / 4) ELSE 0.0 END
  * (CASE WHEN c > r THEN 1.0 WHEN c > 0 THEN exp(1 - r / c) ELSE 0.0 END) * 100, 6) AS sacrebleu, n_pairs
FROM y"""


def _scores(spark, sf, orders=G.BLEU_ORDER):
    """Token n-gram metrics per language, as DataFrame aggregations."""
    pairs = bindings.gen_pairs(spark, sf)
    return G.ngram_scores(G.ngram_stats(pairs, "pair_id", ["lang"], orders), ["lang"])


@query("bleu", sql=_BLEU_SQL)
def bleu(spark, sf):
    """Corpus BLEU-4 x100 per hypothesis language."""
    return _scores(spark, sf).select("lang", "bleu", "n_pairs")


@query("sacrebleu", sql=_SACRE_SQL)
def sacrebleu(spark, sf):
    """A10: smoothed corpus BLEU-4 x100 per hypothesis language."""
    return _scores(spark, sf).select("lang", "sacrebleu", "n_pairs")


@query("rouge_n", sql=f"""
WITH {_PAIRS}, {_ngram_counts('h', 2)}, {_ngram_counts('r', 2)}, {_MATCH},
pp AS (SELECT t.pair_id, t.lang, len(ht) AS h1, len(rt) AS r1,
              greatest(len(ht) - 1, 0) AS h2, greatest(len(rt) - 1, 0) AS r2,
              coalesce(m1.o, 0) AS o1, coalesce(m2.o, 0) AS o2
       FROM t LEFT JOIN m m1 ON m1.pair_id = t.pair_id AND m1.n = 1
              LEFT JOIN m m2 ON m2.pair_id = t.pair_id AND m2.n = 2),
f AS (SELECT lang, o1 / greatest(h1, 1) AS p1, o1 / greatest(r1, 1) AS q1,
                   o2 / greatest(h2, 1) AS p2, o2 / greatest(r2, 1) AS q2 FROM pp)
SELECT lang,
  round(avg(CASE WHEN p1 + q1 > 0 THEN 2 * p1 * q1 / (p1 + q1) ELSE 0.0 END) * 100, 6) AS rouge1,
  round(avg(CASE WHEN p2 + q2 > 0 THEN 2 * p2 * q2 / (p2 + q2) ELSE 0.0 END) * 100, 6) AS rouge2,
  count(*) AS n_pairs
FROM f GROUP BY lang
""")
def rouge_n(spark, sf):
    """ROUGE-1/2 F x100, mean over pairs, per language."""
    return _scores(spark, sf, orders=2).select("lang", "rouge1", "rouge2", "n_pairs")


def _chars(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS_CLASS}', '', 'g')"


@query("chrf", sql=f"""
WITH {_PAIRS},
cs AS (SELECT pair_id, lang, {_chars('hyp')} AS hs, {_chars('ref')} AS rs FROM t),
o AS (SELECT pair_id, lang, hs, rs, unnest([1, 2, 3, 4, 5, 6]) AS n FROM cs),
hg AS (SELECT pair_id, lang, n, g, count(*) AS c FROM (
        SELECT pair_id, lang, n, substring(hs, i, n) AS g
        FROM (SELECT pair_id, lang, n, hs, unnest(range(1, length(hs) - n + 2)) AS i FROM o)) GROUP BY ALL),
rg AS (SELECT pair_id, lang, n, g, count(*) AS c FROM (
        SELECT pair_id, lang, n, substring(rs, i, n) AS g
        FROM (SELECT pair_id, lang, n, rs, unnest(range(1, length(rs) - n + 2)) AS i FROM o)) GROUP BY ALL),
ht AS (SELECT lang, n, sum(c) AS h FROM hg GROUP BY ALL),
rt AS (SELECT lang, n, sum(c) AS r FROM rg GROUP BY ALL),
mt AS (SELECT hg.lang, hg.n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg
       ON hg.pair_id = rg.pair_id AND hg.n = rg.n AND hg.g = rg.g GROUP BY ALL),
pr AS (SELECT l.lang, l.n, coalesce(h, 0) > 0 AND coalesce(r, 0) > 0 AS eff,
              coalesce(m, 0) / h AS p, coalesce(m, 0) / r AS q
       FROM (SELECT DISTINCT lang, n FROM o) l LEFT JOIN ht USING (lang, n)
            LEFT JOIN rt USING (lang, n) LEFT JOIN mt USING (lang, n)),
a AS (SELECT lang, coalesce(sum(p) FILTER (WHERE eff), 0) / count(*) FILTER (WHERE eff) AS P,
             coalesce(sum(q) FILTER (WHERE eff), 0) / count(*) FILTER (WHERE eff) AS R FROM pr GROUP BY lang),
np AS (SELECT lang, count(*) AS n_pairs FROM t GROUP BY lang)
SELECT lang, round(CASE WHEN P + R > 0 THEN 5 * P * R / (4 * P + R) ELSE 0.0 END * 100, 6) AS chrf, n_pairs
FROM a JOIN np USING (lang)
""")
def chrf(spark, sf):
    """chrF (character 1..6-grams, beta 2, whitespace removed) x100."""
    st = G.pair_stats(bindings.gen_pairs(spark, sf), families=("ngram", "chrf"))
    return G.corpus_scores(st, by=["lang"]).select("lang", "chrf", "n_pairs")


@query("rouge_l")
def rouge_l(spark, sf):
    """ROUGE-L (token LCS) and ROUGE-Lsum (union LCS over lines), mean
    F x100.  Checked against a plain-Python DP in tests/test_genmetrics.py."""
    st = G.pair_stats(bindings.gen_pairs(spark, sf), families=("ngram", "lcs", "lsum"))
    return G.corpus_scores(st, by=["lang"]).select("lang", "rougeL", "rougeLsum", "n_pairs")


@query("sacrebleu_meteor")
def sacrebleu_meteor(spark, sf):
    """A10 (smoothed corpus BLEU, default tokenizer) and A12 (METEOR, exact
    stage).  Checked against small Python oracles in tests."""
    st = G.pair_stats(bindings.gen_pairs(spark, sf), families=("ngram", "meteor"))
    return G.corpus_scores(st, by=["lang"]).select("lang", "sacrebleu", "meteor", "n_pairs")
