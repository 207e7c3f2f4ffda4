"""Generation metrics over (hypothesis, reference) pairs: BLEU, chrF,
ROUGE-1/2/L/Lsum, SacreBLEU-style smoothed BLEU, METEOR (exact stage)
(A9-A14, P33).

Plan: tokens are extracted JVM-side; each pair's sufficient statistics (clipped
n-gram matches, n-gram totals, LCS) are computed where the pair lives, token
n-grams for a batch of pairs at once -- no n-gram rows are shuffled; corpus
scores are plain Spark sums over those statistics.  Corpus metrics (BLEU, chrF)
sum first and divide once; sentence metrics (ROUGE, METEOR) average per pair.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import dealt

# Default tokenizer (letter/digit runs, single other symbols),
# orders and weights.
TOKEN_RE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BLEU_ORDER = 4
CHRF_ORDER, CHRF_BETA = 6, 2
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5


def tokens(text) -> Column:
    """Default tokenizer (pluggable: any ``array<string>`` column works)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN_RE), 0)


def _lcs_tokens(a, b) -> int:
    """Bit-parallel LCS over token sequences."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


LSUM_CHUNK = 160_000_000     # table cells (bits) per batch of reference lines
LSUM_CHARS = 2_000_000       # characters of the pairs whose lines are numbered together


class _Lines:
    """A pair's hypothesis and reference lines, numbered."""

    def __init__(self, hyp_lines, ref_lines):
        self.refs = ref_lines
        hyp = [t for line in hyp_lines for t in line]
        self.counts = Counter(hyp), Counter(t for line in ref_lines for t in line)
        self.sizes = len(hyp), sum(map(len, ref_lines))
        vocab: dict = {}
        self.H = np.array([vocab.setdefault(t, len(vocab)) for t in hyp], dtype=np.int64)
        ends = np.cumsum([len(line) for line in hyp_lines if line], dtype=np.int64)
        self.seg = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        self.place = np.arange(len(hyp)) + self.seg      # a free bit after each line
        self.first, self.last = (self.place[x] for x in (np.r_[0, ends[:-1]], ends - 1)) if len(ends) else (ends, ends)
        self.marks = {key: np.zeros(len(r), dtype=bool) for r in ref_lines if r and (key := tuple(r))}
        lines = [(key, np.array([vocab.get(t, -1) for t in key], dtype=np.int64)) for key in self.marks]
        self.todo = [x for x in lines if (x[1] >= 0).any()]

    def hits(self) -> tuple[int, int, int]:
        hits, (hyp_cnt, ref_cnt) = 0, self.counts
        for r in self.refs:
            for jj in np.flatnonzero(self.marks[tuple(r)]) if r else ():
                tok = r[jj]
                if hyp_cnt[tok] > 0 and ref_cnt[tok] > 0:
                    hits += 1
                    hyp_cnt[tok] -= 1
                    ref_cnt[tok] -= 1
        return hits, *self.sizes


def _union_lcs_lines(hyp_lines, ref_lines) -> tuple[int, int, int]:
    return _union_lcs_pairs([(hyp_lines, ref_lines)])[0]


def _union_lcs_pairs(pairs) -> list[tuple[int, int, int]]:
    """ROUGE-Lsum of pairs of lists of lines: for every reference line, the union of
    its LCS token hits over all hypothesis lines; counts are clipped by token frequency.

    All distinct reference lines are processed together: one DP table per
    line, a bit per cell; then every (reference line, hypothesis line) path is
    backtracked in lockstep with the reference DP's tie rule (move up on ties)."""
    found = [_Lines(*p) for p in pairs]
    batch, cells = [], 0
    for x in found:
        for key, R in x.todo:
            batch.append((x, key, R))
            cells += (len(R) + 1) * (int(x.place[-1]) + 2)
            if cells > LSUM_CHUNK:
                _lsum_marks(batch)
                batch, cells = [], 0
    if batch:
        _lsum_marks(batch)
    return [x.hits() for x in found]


def _lsum_table(x: _Lines, Rs) -> np.ndarray:
    """Row I of a line's table is a number with a bit per hypothesis token: 0 where
    the LCS of I reference tokens grows (all hypothesis lines at once, the free bit
    after each takes the carry).  Table values are counts of zeros from a line's start."""
    bits = int(x.place[-1]) + 2
    size = 8 * -(-bits // 64)

    def number(at: np.ndarray) -> int:
        one = np.zeros(bits, bool)
        one[at] = True
        return int.from_bytes(np.packbits(one, bitorder="little").tobytes(), "little")

    by_token = np.argsort(x.H, kind="stable")
    codes, first = np.unique(x.H[by_token], return_index=True)
    used = set(np.concatenate(Rs).tolist())
    masks = {c: number(x.place[at]) for c, at in zip(codes.tolist(), np.split(by_token, first[1:])) if c in used}
    full = number(x.place)
    rows = []
    for R in Rs:
        v = full
        rows.append(v.to_bytes(size, "little"))
        for t in R.tolist():
            u = v & masks.get(t, 0)
            if u:
                v = (v + u | v - u) & full
            rows.append(v.to_bytes(size, "little"))
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, size // 8)


def _lsum_marks(batch) -> None:
    """Bit-parallel DP + lockstep backtrack of reference lines of some pairs; the
    marks are left with their pair."""
    tables, before, start, token, at_bit, bit_of, path = [], [], [], [], [], [], []
    words = rows = bits = 0
    lines = []
    for x, group in groupby(batch, key=lambda b: b[0]):
        group = list(group)
        table = _lsum_table(x, [R for _, _, R in group])
        counts = np.bitwise_count(table)
        tables.append(table.ravel())
        before.append((np.cumsum(counts, axis=1, dtype=np.int32) - counts).ravel())
        start.append(words + np.arange(len(table)) * table.shape[1])
        token += [np.r_[-2, R] for _, _, R in group]
        here = np.full(int(x.place[-1]) + 2, -3, dtype=np.int64)
        here[x.place] = x.H
        at_bit.append(here)
        bit_of.append(np.full(len(table), bits))
        for _, key, R in group:
            lines.append((x, key, rows))
            rows += len(R) + 1
            path.append((np.full(len(x.first), rows - 1), x.last, x.first))
        words, bits = words + table.size, bits + len(here)
    table, before, start, token, at_bit, bit_of = map(np.concatenate, (tables, before, start, token, at_bit, bit_of))
    row, J, A = map(np.concatenate, zip(*path))
    one = np.uint64(1)

    def ones(row, end):   # in front of the bit ``end``
        w = start[row] + (end >> 6)
        return before[w] + np.bitwise_count(table[w] & ((one << (end & 63).astype(np.uint64)) - one))

    def value(row, j, a):
        return j + 1 - a - (ones(row, j + 1) - ones(row, a))

    T = value(row, J, A)
    hit = np.zeros(rows, dtype=bool)
    while True:
        live = T > 0                                     # else no token of the rest matches
        row, J, A, T = row[live], J[live], A[live], T[live]
        if not len(row):
            break
        m = token[row] == at_bit[bit_of[row] + J]
        hit[row[m]] = True
        # Without a match T is the larger neighbour; the upper one is taken on ties.
        grows = (table[start[row] + (J >> 6)] >> (J & 63).astype(np.uint64) & one) == 0
        go_up = m | grows
        ask = np.flatnonzero(~go_up)
        go_up[ask] = value(row[ask] - 1, J[ask], A[ask]) == T[ask]
        row, J, T = row - go_up, J - (m | ~go_up), T - m
    for x, key, r in lines:
        x.marks[key] |= hit[r + 1:r + 1 + len(key)]


def _meteor(h, r) -> float:
    """METEOR with the exact-match stage only (no stemmer/synonym data), on
    lower-cased words: words are paired from the ends of both sentences, then
    Fmean(alpha) and the fragmentation penalty."""
    if not h or not r:
        return 0.0
    h, r = [x.lower() for x in h], [x.lower() for x in r]
    free: dict = {}
    for j, rt in enumerate(r):
        free.setdefault(rt, []).append(j)
    align = []
    for i in range(len(h) - 1, -1, -1):   # last unused occurrence, right to left
        if free.get(h[i]):
            align.append((i, free[h[i]].pop()))
    align.reverse()
    m = len(align)
    if m == 0:
        return 0.0
    p, rc = m / len(h), m / len(r)
    fmean = p * rc / (METEOR_ALPHA * p + (1 - METEOR_ALPHA) * rc)
    chunks = 1
    for (i0, j0), (i1, j1) in zip(align, align[1:]):
        if not (i1 == i0 + 1 and j1 == j0 + 1):
            chunks += 1
    pen = METEOR_GAMMA * (chunks / m) ** METEOR_BETA
    return fmean * (1 - pen)


STATS_SCHEMA = ", ".join(
    [f"bleu_m{n} long, bleu_t{n} long" for n in range(1, BLEU_ORDER + 1)]
    + ["hyp_len long, ref_len long",
       "r1_o long, r1_h long, r1_r long, r2_o long, r2_h long, r2_r long",
       "lcs long, lsum_o long, lsum_h long, lsum_r long, meteor double"]
    + [f"chrf_h{n} long, chrf_r{n} long, chrf_m{n} long" for n in range(1, CHRF_ORDER + 1)])


FAMILIES = ("ngram", "lcs", "lsum", "meteor", "chrf")


def _clipped(hk: np.ndarray, rk: np.ndarray) -> int:
    """Sum over distinct n-grams (numbers below 2^62) of min(hyp count, ref count)."""
    if len(hk) == 0 or len(rk) == 0:
        return 0
    both = np.sort(np.concatenate([hk << 1, rk << 1 | 1]))
    key = both >> 1
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    of_ref = np.add.reduceat(both & 1, first)
    return int(np.minimum(of_ref, np.diff(np.r_[first, len(both)]) - of_ref).sum())


def _match_counts(h_items, r_items, orders) -> dict[int, int]:
    """Clipped n-gram matches for each order, exactly: an n-gram is the number of the
    one before it in the order and the item after that, numbered anew where such
    numbers would not fit in 62 bits."""
    nh = len(h_items)
    if isinstance(h_items, str):
        codes = np.unique(np.frombuffer((h_items + r_items).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1]
    else:
        codes = pd.factorize(np.array([*h_items, *r_items], dtype=object))[0]
    codes = codes.astype(np.int64)
    v = top = int(codes.max(initial=0)) + 1
    sides = gram = codes[:nh], codes[nh:]
    out = {}
    for n in range(1, max(orders) + 1):
        if n > 1:
            if top * v >= 1 << 62:
                which = np.unique(np.concatenate(gram), return_inverse=True)[1]
                gram, top = (which[:len(gram[0])], which[len(gram[0]):]), int(which.max(initial=0)) + 1
            gram, top = tuple(g[:-1] * v + c[n - 1:] for g, c in zip(gram, sides)), top * v
        if n in orders:
            out[n] = _clipped(*gram)
    return out


def _lsum_of(hs, rs) -> list[tuple[int, int, int]]:
    """``_union_lcs_pairs`` of texts, some pairs at a time."""
    out, held, size = [], [], 0
    for k, (h, r) in enumerate(zip(hs, rs)):
        held.append([[TOKEN_PY.findall(x) for x in text.split("\n")] for text in (h, r)])
        size += len(h) + len(r)
        if size >= LSUM_CHARS or k == len(hs) - 1:
            out += _union_lcs_pairs(held)
            held, size = [], 0
    return out


def _pair_stats(ht, rt, hs, rs, fam=FAMILIES, lsum=None) -> dict:
    out = {k.split()[0]: 0 for k in STATS_SCHEMA.split(", ")}
    out["meteor"] = 0.0
    m = _match_counts(ht, rt, range(1, BLEU_ORDER + 1)) if len(ht) and len(rt) else {}
    for n in range(1, BLEU_ORDER + 1):
        out[f"bleu_m{n}"] = m.get(n, 0)
        out[f"bleu_t{n}"] = max(len(ht) - n + 1, 0)
    out["hyp_len"], out["ref_len"] = len(ht), len(rt)
    out["r1_o"], out["r1_h"], out["r1_r"] = out["bleu_m1"], len(ht), len(rt)
    out["r2_o"] = out["bleu_m2"]
    out["r2_h"], out["r2_r"] = max(len(ht) - 1, 0), max(len(rt) - 1, 0)
    ht, rt = list(ht), list(rt)
    if "lcs" in fam:
        out["lcs"] = _lcs_tokens(ht, rt)
    if "lsum" in fam:
        out["lsum_o"], out["lsum_h"], out["lsum_r"] = lsum or _lsum_of([hs], [rs])[0]
    if "meteor" in fam:
        out["meteor"] = _meteor(ht, rt)
    if "chrf" not in fam:
        return out
    hc_chars, rc_chars = "".join(hs.split()), "".join(rs.split())
    cm = _match_counts(hc_chars, rc_chars, range(1, CHRF_ORDER + 1)) \
        if hc_chars and rc_chars else {}
    for n in range(1, CHRF_ORDER + 1):
        out[f"chrf_h{n}"] = max(len(hc_chars) - n + 1, 0)
        out[f"chrf_r{n}"] = max(len(rc_chars) - n + 1, 0)
        out[f"chrf_m{n}"] = cm.get(n, 0)
    return out


try:  # the Python side of the tokenizer, for line-level ROUGE-Lsum
    import regex as _regex
    TOKEN_PY = _regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")
except ImportError:  # pragma: no cover
    import re as _re
    TOKEN_PY = _re.compile(r"[^\W_]+|_|[^\w\s]")


def _stats_udf(fam: tuple[str, ...]):
    @F.pandas_udf(STATS_SCHEMA)
    def pair_stats_udf(ht: pd.Series, rt: pd.Series, hs: pd.Series, rs: pd.Series) -> pd.DataFrame:
        lsum = _lsum_of(hs, rs) if "lsum" in fam else [None] * len(hs)
        rows = [_pair_stats(a, b, c, d, fam, x) for a, b, c, d, x in zip(ht, rt, hs, rs, lsum)]
        return pd.DataFrame(rows, columns=[k.split()[0] for k in STATS_SCHEMA.split(", ")])
    return pair_stats_udf


def pair_stats(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref",
               families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """P33 (null -> '') then per-pair statistics as columns.  ``families``
    limits the work to the metrics needed (n-gram counts are always kept)."""
    h = F.coalesce(F.col(hyp), F.lit(""))
    r = F.coalesce(F.col(ref), F.lit(""))
    udf = _stats_udf(tuple(families))
    pairs = dealt(pairs)   # CPU-bound per pair
    return pairs.withColumn("_st", udf(tokens(h), tokens(r), h, r)).select("*", "_st.*") \
                .drop("_st")


def _f(p: Column, r: Column, beta2: float = 1.0) -> Column:
    return F.when((p + r) > 0, (1 + beta2) * p * r / (beta2 * p + r)).otherwise(F.lit(0.0))


def _div0(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _counts(lists: list[pa.ListArray], orders: int) -> np.ndarray:
    """pairs x orders x (clipped matches, n-grams of the first list, of the second)
    of two columns of token lists, exactly (n-grams are numbered, not hashed)."""
    pairs = len(lists[0])
    sizes = [np.diff(np.asarray(x.offsets, np.int64)) for x in lists]
    codes = np.asarray(pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices, np.int64)
    owner = np.concatenate([np.repeat(np.arange(pairs), n) for n in sizes])
    side = np.repeat([0, 1], [n.sum() for n in sizes])
    out = np.zeros((pairs, orders, 3), np.int64)
    gram, left = codes, np.arange(len(codes))
    for n in range(orders):
        if n:
            # An n-gram is the one before it in the order, and the token after that.
            inside = left + n < len(codes)
            inside[inside] &= (owner[left[inside]] == owner[left[inside] + n]) & (side[left[inside]] == side[left[inside] + n])
            gram, left = gram[inside], left[inside]
            gram = np.unique(gram * (codes.max(initial=0) + 1) + codes[left + n], return_inverse=True)[1]
        key, where = np.unique(owner[left] * (gram.max(initial=0) + 1) + gram, return_inverse=True)
        mine = np.zeros(len(key), np.int64)
        mine[where] = owner[left]
        both = [np.bincount(where[side[left] == k], minlength=len(key)) for k in (0, 1)]
        for k, x in enumerate((np.minimum(*both), *both)):
            out[:, n, k] = np.bincount(mine, x, minlength=pairs)
    return out


#: Pairs whose n-grams are numbered together.
_PAIRS = 512


def ngram_stats(pairs: DataFrame, id_col: str, by: list[str], orders: int = BLEU_ORDER,
                hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(id, by, n, m, h, r): per pair and order the clipped matches and the
    n-grams of both sides; a narrow pass, whose tasks count some pairs at a time."""
    h, r = (tokens(F.coalesce(F.col(c), F.lit(""))) for c in (hyp, ref))
    base = dealt(pairs.select(id_col, *by, hyp, ref), id_col).select(id_col, *by, h.alias("_h"), r.alias("_r"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-2])
    k = 1 + len(by)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(start, _PAIRS)
                found = _counts([part.column(k), part.column(k + 1)], orders)
                who = pa.array(np.repeat(np.arange(part.num_rows), orders))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(who) for i in range(k)), pa.array(np.tile(np.arange(1, orders + 1, dtype=np.int32), part.num_rows)),
                     *(pa.array(found[:, :, x].ravel()) for x in range(3))], names=[*part.schema.names[:k], "n", "m", "h", "r"])

    return base.mapInArrow(run, f"{fields}, n int, m long, h long, r long")


def ngram_scores(stats: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """bleu, sacrebleu, rouge1, rouge2 (x100) and n_pairs from ``ngram_stats``."""
    at = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    rouge = _f(_div0(F.col("m"), F.col("h")), _div0(F.col("m"), F.col("r")))
    sums = stats.groupBy(*by).agg(
        *[at(n, c).alias(f"{c}{n}") for n in range(1, BLEU_ORDER + 1) for c in ("m", "h")], at(1, "r").alias("r1"),
        F.count_if(F.col("n") == 1).alias("n_pairs"),
        *[F.avg(F.when(F.col("n") == n, rouge)).alias(f"rouge{n}") for n in (1, 2)])
    exact, smooth, k = [], [], F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        m, t = F.col(f"m{n}"), F.col(f"h{n}")
        k = k + F.when((m == 0) & (t > 0), 1).otherwise(0)
        exact.append(_div0(m, t))
        smooth.append(F.when(t > 0, F.when(m > 0, m / t).otherwise(F.lit(1.0) / (F.pow(F.lit(2.0), k) * t))).otherwise(0.0))
    c, r = F.col("h1"), F.col("r1")
    short = F.when(c > r, F.lit(1.0)).when(c > 0, F.exp(1 - r / c)).otherwise(F.lit(0.0))
    geo = lambda ps: F.when(F.least(*ps) > 0, F.exp(sum(F.log(p) for p in ps) / BLEU_ORDER)).otherwise(F.lit(0.0))
    return sums.select(*by, F.round(geo(exact) * short * 100, digits).alias("bleu"),
                       F.round(geo(smooth) * short * 100, digits).alias("sacrebleu"),
                       *[F.round(F.col(f"rouge{n}") * 100, digits).alias(f"rouge{n}") for n in (1, 2)], "n_pairs")


def corpus_scores(stats: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """All metrics x100 from summed statistics (one aggregate)."""
    by = by or []
    S = {c: F.sum(c) for c in stats.columns if c.startswith(("bleu_", "chrf_", "hyp_len", "ref_len"))}
    prec = [_div0(S[f"bleu_m{n}"], S[f"bleu_t{n}"]) for n in range(1, BLEU_ORDER + 1)]
    geo = F.when(F.least(*prec) > 0,
                 F.exp(sum(F.log(p) for p in prec) / BLEU_ORDER)).otherwise(F.lit(0.0))
    c, r = S["hyp_len"], S["ref_len"]
    bp = F.when(c > r, F.lit(1.0)).when(c > 0, F.exp(1 - r / c)).otherwise(F.lit(0.0))
    # chrF: per-order precision/recall from summed counts, averaged over orders
    # (effective orders only: both sides have n-grams of that order)
    eff = [(S[f"chrf_h{n}"] > 0) & (S[f"chrf_r{n}"] > 0) for n in range(1, CHRF_ORDER + 1)]
    n_eff = sum(F.when(e, 1).otherwise(0) for e in eff)
    cp = sum(F.when(e, S[f"chrf_m{n}"] / S[f"chrf_h{n}"]).otherwise(0.0)
             for n, e in zip(range(1, CHRF_ORDER + 1), eff))
    cr = sum(F.when(e, S[f"chrf_m{n}"] / S[f"chrf_r{n}"]).otherwise(0.0)
             for n, e in zip(range(1, CHRF_ORDER + 1), eff))
    chrf = F.when(n_eff > 0, _f(cp / n_eff, cr / n_eff, CHRF_BETA ** 2)).otherwise(0.0)

    def rouge(o, h, r_):
        return _f(_div0(F.col(o), F.greatest(F.col(h), F.lit(1))),
                  _div0(F.col(o), F.greatest(F.col(r_), F.lit(1))))
    rl = F.when((F.col("hyp_len") > 0) & (F.col("ref_len") > 0),
                _f(F.col("lcs") / F.col("hyp_len"), F.col("lcs") / F.col("ref_len"))).otherwise(0.0)
    rlsum = F.when((F.col("lsum_h") > 0) & (F.col("lsum_r") > 0),
                   _f(F.col("lsum_o") / F.col("lsum_h"), F.col("lsum_o") / F.col("lsum_r"))) \
             .otherwise(0.0)
    # SacreBLEU-style exponential smoothing: the k-th order without a match
    # counts as 1 / (2^k * n-grams); an order without n-grams makes the score 0
    sm, k = [], F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        m, t = S[f"bleu_m{n}"], S[f"bleu_t{n}"]
        k = k + F.when((m == 0) & (t > 0), 1).otherwise(0)
        sm.append(F.when(t > 0, F.when(m > 0, m / t).otherwise(F.lit(1.0) / (F.pow(F.lit(2.0), k) * t))).otherwise(F.lit(0.0)))
    sgeo = F.when(F.least(*sm) > 0, F.exp(sum(F.log(p) for p in sm) / BLEU_ORDER)).otherwise(0.0)
    out = stats.groupBy(*by).agg(
        F.round(geo * bp * 100, digits).alias("bleu"),
        F.round(sgeo * bp * 100, digits).alias("sacrebleu"),
        F.round(chrf * 100, digits).alias("chrf"),
        F.round(F.avg(rouge("r1_o", "r1_h", "r1_r")) * 100, digits).alias("rouge1"),
        F.round(F.avg(rouge("r2_o", "r2_h", "r2_r")) * 100, digits).alias("rouge2"),
        F.round(F.avg(rl) * 100, digits).alias("rougeL"),
        F.round(F.avg(rlsum) * 100, digits).alias("rougeLsum"),
        F.round(F.avg("meteor") * 100, digits).alias("meteor"),
        F.count(F.lit(1)).alias("n_pairs"))
    return out
