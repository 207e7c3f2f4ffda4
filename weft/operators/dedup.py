"""Deduplication: exact first-row-wins (U3/W4/A18), fuzzy indel self-join
(J7/O3; its candidates are in ``fuzzy``).

Every step is a Spark job: grouping and joins shuffle on hashed keys, hot keys
are combined map-side (``min``/``count`` aggregates are partial), and no group
is ever collected into one task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.fuzzy import Windows, candidate_pairs, codes, with_bins
from weft.operators.fuzzy_blocks import meeting_blocks, similar_by_block
from weft.sources.tables import dealt


def text_key(c: Column) -> Column:
    """Shuffle key for a text: SHA-256 digest (32 bytes) instead of the text.

    Grouping on the digest keeps whole texts out of the shuffle; SHA-256 has
    no known collisions, so equal digests mean equal texts.  A null text is a
    key of its own, not the empty text's.
    """
    return F.unhex(F.sha2(c, 256))


def exact_dedup(df: DataFrame, key: str, order_col: str,
                keep_cols: list[str] | None = None) -> DataFrame:
    """One row per distinct ``key``: the row with the smallest ``order_col``.

    ``min(struct(order, ...))`` is a partial aggregate, so a key holding a third
    of all rows is combined inside each map task before the shuffle.
    Adds ``n_copies`` (rows sharing the key).
    """
    keep_cols = [c for c in (keep_cols or []) if c != order_col]
    first = F.min(F.struct(F.col(order_col), *[F.col(c) for c in keep_cols]))
    return (df.groupBy(text_key(F.col(key)).alias("_k"))
              .agg(first.alias("_first"), F.count(F.lit(1)).alias("n_copies"))
              .select("_first.*", "n_copies"))


def dedup_summary(kept: DataFrame, copies_col: str = "n_copies") -> DataFrame:
    """Original / after / removed counts as one row.

    Computed from the survivors' copy counts in one aggregate, so the input is
    scanned once and no second count or join is needed.
    """
    return (kept.agg(F.sum(copies_col).cast("bigint").alias("n_original"),
                     F.count(F.lit(1)).alias("n_after"))
                .withColumn("n_removed", F.col("n_original") - F.col("n_after")))


# ---------------------------------------------------------------------------
# Fuzzy self-join on indel similarity (exact, lossless blocking)
# ---------------------------------------------------------------------------

def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence length, bit-parallel (Allison-Dix/Hyyro):
    one pass over ``a`` with machine-word arithmetic on a |b|-bit vector."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for j, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << j)
    full = (1 << m) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


QGRAM = 6


def shared_qgrams(a: str, b: str, q: int = QGRAM) -> int:
    """Multiset count of q-grams (rolling hashes) shared by ``a`` and ``b``.
    Hash collisions can only raise the count."""
    ha, hb = (Windows(codes(x)).hashes(np.arange(max(0, len(x) - q + 1)), q) for x in (a, b))
    if len(ha) == 0 or len(hb) == 0:
        return 0
    ua, ca = np.unique(ha, return_counts=True)
    ub, cb = np.unique(hb, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def common_start(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def letter_masks(text: str) -> dict[str, int]:
    """For every character of a text the number with its places as bits."""
    c, masks = codes(text), {}
    letters, often = np.unique(c, return_counts=True)
    for letter in letters[often > 8]:
        masks[chr(letter)] = int.from_bytes(np.packbits(c == letter, bitorder="little").tobytes(), "little")
    for j in np.flatnonzero(np.isin(c, letters[often <= 8])).tolist():
        masks[text[j]] = masks.get(text[j], 0) | (1 << j)
    return masks


@lru_cache(1024)
def _kept_masks(text: str) -> dict[str, int]:
    return letter_masks(text)


def lcs_at_least(a: str, b: str, need: int) -> int:
    """Bit-parallel LCS of what stands between the common start and end, within the
    band where an LCS of ``need`` can run: at place i of ``a`` the bits of ``b`` from i
    less what ``a`` may leave out to i plus what ``b`` may leave out.  It stops early
    (checked every 256 characters) once even matching every remaining character could
    not reach ``need``.  Returns the LCS if it is ``need`` or more, else a number below."""
    if len(a) < len(b):
        a, b = b, a
    start, whole = common_start(a, b), b
    a, b = a[start:], b[start:]
    end = common_start(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    same = start + end
    need = max(0, need - same)
    m, n = len(b), len(a)
    if need > m:
        return -1
    if m == 0:
        return same
    masks = (_kept_masks if len(whole) <= 8192 else letter_masks)(whole)
    v = low = high = done = 0        # v: the bits from low to high; done: matches below low
    for i in range(0, n, 256):
        gone = max(0, i - (n - need)) - low
        if gone > 0:
            done += gone - (v & ((1 << gone) - 1)).bit_count()
            v, low = v >> gone, low + gone
        more = min(m, i + 256 + m - need) - high
        if more > 0:
            v |= ((1 << more) - 1) << (high - low)
            high += more
        full = (1 << (high - low)) - 1
        near = {ch: masks.get(ch, 0) >> start + low & full for ch in set(a[i:i + 256])}
        for ch in a[i:i + 256]:
            u = v & near[ch]
            v = ((v + u) | (v - u)) & full
        if done + high - low - v.bit_count() + max(0, n - i - 256) < need:
            return -1
    return same + done + high - low - v.bit_count()


def lcs_if_possible(a: str, b: str, t: int) -> int:
    """LCS when the pair can still reach ratio ``t``, else -1.

    Count filter (lossless): with indel distance D, a and b share at least
    ``max(|a|,|b|) - q + 1 - q*D`` q-grams; D is at most
    ``floor((100-t)(|a|+|b|)/100)``.  Survivors run the early-stopping LCS."""
    la, lb = len(a), len(b)
    d_max = (100 - t) * (la + lb) // 100
    need_q = max(la, lb) - QGRAM + 1 - QGRAM * d_max
    if need_q > 0 and max(la, lb) > 256 and shared_qgrams(a, b) < need_q:
        return -1
    return lcs_at_least(a, b, -((-t * (la + lb)) // 200))


def _lcs_udf(t: int = 95):
    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_if_possible(x or "", y or "", t) for x, y in zip(a, b)],
                         dtype="int64")
    return lcs


def similar_pairs(strings: DataFrame, id_col: str, text_col: str,
                  threshold: int = 95) -> DataFrame:
    """Verified similar pairs (id_a, id_b, len_a, len_b, lcs): block by block, where
    both texts are.  ``candidate_pairs`` then ``verify_pairs`` gives the same rows, but
    shuffles a row for every common segment."""
    return similar_by_block(meeting_blocks(strings, id_col, text_col, threshold), threshold, lcs_at_least)


def verify_pairs(cand: DataFrame, strings: DataFrame, id_col: str, text_col: str,
                 threshold: int = 95) -> DataFrame:
    """Exact check of candidate pairs: ``200*LCS >= t*(|a|+|b|)``."""
    t = int(threshold)
    texts = with_bins(strings, id_col, text_col)
    ta = texts.withColumnsRenamed({"id": "id_a", "s": "s_a", "n": "len_a", "bins": "bins_a"}).hint("merge")
    tb = texts.withColumnsRenamed({"id": "id_b", "s": "s_b", "n": "len_b", "bins": "bins_b"}).hint("merge")
    # The indel distance is at least the difference of the character counts.
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = cand.join(ta, "id_a").join(tb, "id_b").where(100 * apart <= (100 - t) * (F.col("len_a") + F.col("len_b")))
    pairs = dealt(near.drop("bins_a", "bins_b"), "id_a", "id_b")
    lcs = _lcs_udf(t)
    return (pairs.withColumn("lcs", lcs(F.col("s_a"), F.col("s_b")))
                 .where(200 * F.col("lcs") >= t * (F.col("len_a") + F.col("len_b")))
                 .select("id_a", "id_b", "len_a", "len_b", "lcs"))


def fuzzy_dedup(df: DataFrame, key: str, order_col: str, keep_cols: list[str] | None = None,
                threshold: int = 95) -> tuple[DataFrame, DataFrame]:
    """K4: a row is removed iff an earlier row (smaller ``order_col``) has an
    identical key or a key with indel ratio >= ``threshold``.

    Not transitive and not greedy: an earlier row removes a later one even if
    it is itself removed.  No cap on the number of matches per string.
    Returns (kept rows, verified pairs between distinct keys).
    """
    keep_cols = keep_cols or []
    distinct = exact_dedup(df.withColumn("_key", F.coalesce(F.col(key), F.lit(""))),
                           "_key", order_col, ["_key", *keep_cols])
    blocks = meeting_blocks(distinct, order_col, "_key", threshold)
    pairs = similar_by_block(blocks, threshold, lcs_at_least)
    # ids are the first row of each distinct key, so the larger id is removed; one
    # earlier row is enough, so a family of n similar texts has no n^2 pairs verified
    removed = (similar_by_block(blocks, threshold, lcs_at_least, every=False)
               .select(F.col("id_b").alias(order_col)).distinct())
    # the same rows without their texts, which are not shuffled again
    kept = exact_dedup(df.withColumn("_key", F.coalesce(F.col(key), F.lit(""))), "_key", order_col, keep_cols)
    return kept.join(removed, order_col, "left_anti"), pairs
