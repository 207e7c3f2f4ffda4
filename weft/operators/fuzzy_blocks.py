"""Similar pairs of texts, found and verified where both texts are.

Texts are cut into blocks by length band, and two blocks that may hold similar
texts meet in one task: one is indexed by the chunks of ``fuzzy_index``, the other one's
windows are looked up, and who shares enough chunks is compared at once (addresses and
other short texts by their signatures).  Neither chunks, windows nor candidates are ever rows; what leaves a task are the pairs that
reach the threshold.  A band is one block on either side until it exceeds
``INDEX_CHARS`` or ``PROBE_CHARS``; it is cut further by ``MEETINGS`` as long as that
sends few characters more (``COPIED``).  So texts are shuffled about twice, and more
often where a band is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.fuzzy import Budget, Windows, codes
from weft.operators.fuzzy_index import Chunks, near_short
from weft.session import scratch_path
from weft.sources.tables import dealt

#: Most characters of an indexed block and of one that is looked up.
INDEX_CHARS, PROBE_CHARS = 48_000_000, 96_000_000
#: Pairs of a task, for which a band is cut further, and up to how many characters.
MEETINGS, COPIED = 1 << 26, 64_000_000
#: Bins of the character counts that two texts are compared by first; length of the grams.
BINS, GRAM = 64, 6
#: Characters of the longest texts that are compared by their signatures.
SHORT = 64
#: Short pairs verified at once; candidates gathered before they are verified.
_SHORT, _HELD = 1 << 16, 1 << 20


def short_lcs(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of pairs whose texts in ``b`` have 64 characters at most:
    ``dedup.lcs_length`` for many pairs at once, a machine word each."""
    letters = {c: k + 1 for k, c in enumerate(sorted(set().union(*map(set, b))))}
    who = {t: k for k, t in enumerate(dict.fromkeys(b))}
    masks = np.zeros((len(who), len(letters) + 1), np.uint64)
    for t, k in who.items():
        for j, c in enumerate(t):
            masks[k, letters[c]] |= np.uint64(1 << j)
    row = np.array([who[t] for t in b])
    rows = {t: k for k, t in enumerate(dict.fromkeys(a))}
    spelt = np.zeros((len(rows), max(map(len, rows))), np.int32)
    for t, k in rows.items():
        spelt[k, :len(t)] = [letters.get(c, 0) for c in t]
    spelt = spelt[[rows[t] for t in a]]
    full = np.array([(1 << len(t)) - 1 for t in b], np.uint64)
    v = full.copy()
    for i in range(spelt.shape[1]):
        u = v & masks[row, spelt[:, i]]
        v = (v + u | v - u) & full
    return np.array([len(t) for t in b]) - np.bitwise_count(v)


class Verifier:
    """LCS lengths of candidates that can reach the threshold, by cheaper bounds first."""

    def __init__(self, texts: list[str], t: int, lcs: Callable[[str, str, int], int]):
        self.texts, self.t, self.lcs = texts, t, lcs
        self.n = np.array([len(x) for x in texts], np.int64)
        self.bins = np.stack([np.bincount((codes(x) * np.uint64(0x9E3779B1) >> np.uint64(7) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                              for x in texts]).astype(np.int32)
        self.grams = lru_cache(1024)(self._grams)

    def _grams(self, i: int):
        x = self.texts[i]
        return np.unique(Windows(codes(x)).hashes(np.arange(max(0, len(x) - GRAM + 1)), GRAM), return_counts=True)

    def possible(self, i: int, j: int) -> bool:
        """Each edit changes ``GRAM`` grams at most; collisions only raise what is shared."""
        need = max(self.n[i], self.n[j]) - GRAM + 1 - GRAM * ((100 - self.t) * (self.n[i] + self.n[j]) // 100)
        if need <= 0:
            return True
        (ua, ca), (ub, cb) = self.grams(i), self.grams(j)
        at = np.searchsorted(ub, ua)
        at[at == len(ub)] = 0
        same = ub[at] == ua
        return int(np.minimum(ca[same], cb[at[same]]).sum()) >= need

    def __call__(self, i: np.ndarray, j: np.ndarray, *more: np.ndarray):
        """(i, j, lcs, *more) of the pairs that reach the threshold; texts ``i`` are not longer."""
        size = self.n[i] + self.n[j]
        near = np.concatenate([np.abs(self.bins[i[k:k + 8192]] - self.bins[j[k:k + 8192]]).sum(axis=1) for k in range(0, len(i), 8192)] or [size])
        i, j, size, *more = (x[100 * near <= (100 - self.t) * size] for x in (i, j, size, *more))
        out = np.full(len(i), -1, np.int64)
        short = self.n[i] <= 64
        at = np.flatnonzero(short)
        for k in range(0, len(at), _SHORT):
            some = at[k:k + _SHORT]
            out[some] = short_lcs([self.texts[x] for x in j[some]], [self.texts[x] for x in i[some]])
        for k in np.flatnonzero(~short):
            if self.possible(int(j[k]), int(i[k])):
                out[k] = self.lcs(self.texts[i[k]], self.texts[j[k]], -(-self.t * int(size[k]) // 200))
        good = 200 * out >= self.t * size
        return i[good], j[good], out[good], *(x[good] for x in more)


def verified(verify: Verifier, s: np.ndarray, r: np.ndarray, later: np.ndarray, found: np.ndarray) -> list[tuple]:
    """Pairs of the candidates that reach the threshold, one at least for each text of
    ``later`` (of each candidate the text that comes later) that has any: its first
    candidates, then twice as many, until one does.  ``found``, by text, is updated."""
    out, many = [], 1
    while len(s):
        order = np.argsort(later, kind="stable")
        s, r, later = s[order], r[order], later[order]
        begins = np.flatnonzero(np.diff(later, prepend=-1))
        now = np.arange(len(s)) - np.repeat(begins, np.diff(begins, append=len(s))) < many
        out.append(verify(s[now], r[now], later[now]))
        found[out[-1][3]] = True
        left = ~now & ~found[later]
        s, r, later, many = s[left], r[left], later[left], 2 * many
    return [x[:3] for x in out]


def similar_in_block(texts: list[str], order: np.ndarray, indexed: int, probes: np.ndarray, b: Budget, lcs, every: bool = True) -> tuple:
    """(s, r, lcs), as places in ``texts``: similar pairs of one of the first
    ``indexed`` texts s and a text r of ``probes`` that is longer, or as long and later
    in ``order``; all of them, or without ``every`` one at least for each text that has
    an earlier one in ``order``."""
    n = np.array([len(x) for x in texts], np.int64)
    if n[:indexed].max() <= SHORT and n.max() <= 1.5 * SHORT:
        s, r, length = near_short(texts, order, indexed, probes, b.t)
        one = slice(None) if every else np.unique(np.where(order[s] > order[r], s, r), return_index=True)[1]
        return s[one], r[one], length[one]
    index, verify, found = Chunks(texts[:indexed], b), Verifier(texts, b.t, lcs), np.zeros(len(texts), bool)
    out, held, size = [(np.zeros(0, np.int64),) * 3], [], 0

    def settle():
        s, r, later, times = map(np.concatenate, zip(*held))
        if every:
            return [verify(s, r)]
        best = np.argsort(-times, kind="stable")
        return verified(verify, s[best], r[best], later[best], found)
    for s, r, times in index.sharing([texts[x] for x in probes]):
        r = probes[r]
        later = np.where(order[s] > order[r], s, r)
        good = np.flatnonzero(((n[s] < n[r]) | (order[s] < order[r])) & (every | ~found[later]))
        held.append((s[good], r[good], later[good], times[good]))
        size += len(good)
        if size > _HELD:
            out += settle()
            held, size = [], 0
    return tuple(map(np.concatenate, zip(*out, *(settle() if held else ()))))


def block_counts(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(band, blocks indexed, blocks looked up) from (band, texts, characters, texts
    looked up, their characters)."""
    out = []
    for band, n, chars, m, looked in rows:
        s, t = -(-chars // INDEX_CHARS), -(-looked // PROBE_CHARS)
        while s * t * MEETINGS < n * m:
            more = (s + 1, t) if n * t > m * s else (s, t + 1)
            if chars * more[1] + looked * more[0] > max(COPIED, 2 * (chars + looked)):
                break
            s, t = more
        out.append((band, s, t))
    return out


def meeting_blocks(strings: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """(band, i, j, side, id, s): the texts of every two blocks that may hold similar
    ones; equal texts should be merged before, empty and null texts are in no block.
    side 0: indexed, 2: looked up, 1: both, where the two blocks of a text in its band meet."""
    spark, b = strings.sparkSession, Budget(int(threshold))
    path = scratch_path(spark, "fuzzy")
    low = F.pandas_udf(lambda n: pd.Series(b.band(np.maximum(b.shortest(n.to_numpy()), 1))), "long")
    high = F.pandas_udf(lambda n: pd.Series(b.band(n.to_numpy())), "long")
    n = F.length(text_col).cast("long")
    (strings.select(F.col(id_col).alias("id"), F.col(text_col).alias("s"), n.alias("n")).where("n > 0")
            .select("*", low("n").alias("low"), high("n").alias("high")).write.parquet(path))
    base = spark.read.parquet(path)
    looked = F.explode(F.sequence("low", "high")).alias("band")
    sizes = (base.groupBy(F.col("high").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))
                 .join(base.select("n", looked).groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("looked")), "band"))
    counts = spark.createDataFrame(block_counts([tuple(r) for r in sizes.collect()]) or [(-1, 1, 1)], "band long, indexed long, probed long")
    salt = F.xxhash64("id")
    at_i, at_j = F.pmod(salt, "indexed"), F.pmod(salt, "probed")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    index = (base.select("id", "s", F.col("high").alias("band")).join(F.broadcast(counts), "band")
                 .select("band", "id", "s", at_j.alias("own"), at_i.alias("i"), each("probed").alias("j"))
                 .select("band", "i", "j", F.when(F.col("j") == F.col("own"), 1).otherwise(0).alias("side"), "id", "s"))
    probe = (base.select("id", "s", "high", looked).join(F.broadcast(counts), "band")
                 .select("band", "id", "s", "high", at_i.alias("own"), each("indexed").alias("i"), at_j.alias("j"))
                 .where((F.col("band") != F.col("high")) | (F.col("i") != F.col("own")))
                 .select("band", "i", "j", F.lit(2).alias("side"), "id", "s"))
    return dealt(index.unionByName(probe), "band", "i", "j")


def similar_by_block(blocks: DataFrame, threshold: int, lcs: Callable[[str, str, int], int], every: bool = True) -> DataFrame:
    """(id_a, id_b, len_a, len_b, lcs), id_a < id_b, of ``meeting_blocks``: every pair of
    texts that reaches the threshold, or without ``every`` one at least for each id_b
    that is in any.  ``lcs(a, b, need)`` is their LCS, or a number below ``need``."""
    b, kind = Budget(int(threshold)), blocks.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        rows = np.argsort(side, kind="stable")      # the texts stay where they are
        indexed, probes = int((side < 2).sum()), np.flatnonzero(side[rows] > 0)
        ids, texts = table.column("id").take(pa.array(rows)).combine_chunks(), table.column("s").to_pylist()
        texts = [texts[k] for k in rows.tolist()]
        order = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
        found = (np.zeros(0, np.int64),) * 3
        if indexed and len(probes):
            found = similar_in_block(texts, order, indexed, probes, b, lcs, every)
        s, r, length = found
        a, c = np.where(order[s] < order[r], s, r), np.where(order[s] < order[r], r, s)
        size = np.array([len(x) for x in texts], np.int64)
        return pa.table({"id_a": ids.take(pa.array(a)), "id_b": ids.take(pa.array(c)), "len_a": size[a], "len_b": size[c], "lcs": length.astype(np.int64)})

    return blocks.groupBy("band", "i", "j").applyInArrow(run, f"id_a {kind}, id_b {kind}, len_a long, len_b long, lcs long")
