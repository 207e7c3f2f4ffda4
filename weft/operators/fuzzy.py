"""Candidate pairs of texts with an indel ratio of at least t % (lossless).

A pair with lengths |s| <= |r| and indel distance D has a ratio of t or more iff
100 D <= (100 - t)(|s| + |r|).  So |r| <= |s|(200 - t)/t, and D <= K(|s|), the
budget with the longest such r.  Cut s into K + m segments: D edits touch K of
them at most, so m others stand in r, each shifted by K characters at most.

* ``segments`` writes an index of the segments of every text: the key hashes the
  segment together with its width, the text's length band (a factor of
  (200 - t)/t) and the bucket of its place (2 K + 1 characters).
* Of these segments the most frequent ones of a text are left out of the index
  (``dropped``, half of m): of those that stay, m - dropped stand in r, too.
  How frequent a segment is comes from ``frequencies``, counts by hash in a table
  of fixed size; it only decides which segments to take.  So what nearly all texts
  share (a template, an address prefix) meets nothing.
* ``sketch`` reduces the index to one bit a key, in a bitmap of fixed size.
* ``windows`` takes every window of the widths that an admissible shorter partner
  may have, for the bands and buckets (two of each at most) where a partner's
  segment may lie, and gives rows for those alone whose bit is set: the windows
  that no text's segment can meet leave no row.
* The join on the key is a shuffle join of plain columns, which adaptive execution
  splits where one key is frequent.  Pairs with enough common segments are
  candidates.

m grows with K (a tenth of it, 6 at least), as long texts have hundreds of short
segments; shorter texts use 3 or 1, so that a segment has 3 characters or more.  A
fuller bitmap passes more rows and loses none.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import scratch_path

#: Bits of the bitmap (a power of two): what is collected and broadcast is 16 MB at most.
SKETCH_BITS = 27
#: Counts of the frequency table (a power of two): 16 MB at most.
COUNT_BITS = 20
_B = 0x100000001B3                      # odd multiplier: invertible mod 2^64
_BINV = pow(_B, -1, 1 << 64)


@dataclasses.dataclass(frozen=True)
class Budget:
    """Lengths, edits and segments at a threshold of ``t`` %; on numpy arrays."""
    t: int

    def longest(self, n):
        return n * (200 - self.t) // self.t

    def shortest(self, n):
        return -(-n * self.t // (200 - self.t))

    def edits(self, n):
        return (100 - self.t) * (n + self.longest(n)) // 100

    def spare(self, n):
        """m of a text of length n."""
        k = self.edits(n)
        m = np.maximum(6, k // 10)
        return np.where(n >= 3 * (k + m), m, np.where(n >= 3 * (k + 3), 3, 1))

    def dropped(self, m):
        """How many of a text's most frequent segments are not indexed."""
        return m // 2

    def band(self, n):
        return np.floor(np.log(np.maximum(n, 1)) / np.log((200 - self.t) / self.t) + 1e-9).astype(np.int64)

    def reach(self, band):
        """Edits of the longest text of a band, or a few more."""
        return self.edits(np.floor(((200 - self.t) / self.t) ** (band + 1.0)).astype(np.int64) + 2)


def codes(text: str) -> np.ndarray:
    """Code points (what Spark's ``length`` and Python's ``len`` count)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class Windows:
    """Polynomial hashes of any windows of a text, each in constant time:
    h(q, w) = (S[q+w] - S[q]) B^(q+w-1), S the prefix sums of c[k] B^-k (mod 2^64)."""

    def __init__(self, c: np.ndarray):
        n = len(c)
        self.n = n
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _B, np.uint64))])
            inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BINV, np.uint64))])
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * inverse[:n])])

    def hashes(self, q: np.ndarray, w) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[q + w] - self.sums[q]) * self.power[q + w - 1]


def _key(h: np.ndarray, width, band, bucket) -> np.ndarray:
    with np.errstate(over="ignore"):
        extra = (np.asarray(width, np.uint64) << np.uint64(40)) ^ (np.asarray(band, np.uint64) << np.uint64(32)) ^ np.asarray(bucket, np.uint64)
        x = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + extra * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(31)


def text_segments(text: str, b: Budget, counts: np.ndarray | None = None):
    """(keys, number of the segment, place) of a text's segments, its K, and how
    many a similar text shares; with ``counts`` of the rarer segments alone."""
    c = codes(text)
    n = len(c)
    k, m = int(b.edits(n)), int(b.spare(np.int64(n)))
    many = k + m
    w0, extra = divmod(n, many)
    i = np.arange(many)
    w = w0 + (i >= many - extra)
    p = i * w0 + np.maximum(0, i - (many - extra))
    band = int(b.band(np.int64(n)))
    keys = _key(Windows(c).hashes(p, w), w, band, p // (2 * int(b.reach(np.int64(band))) + 1))
    if counts is None:
        return keys, i, p, k, m
    gone = int(b.dropped(np.int64(m)))
    kept = np.sort(np.argsort(counts[(keys >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:many - gone])
    return keys[kept], i[kept], p[kept], k, m - gone


def text_windows(text: str, b: Budget, bits: np.ndarray | None, only: int | None = None):
    """(keys, place) of the windows of a text that may meet a segment (of a text in
    the length band ``only``)."""
    c = codes(text)
    n = len(c)
    lengths = np.arange(int(b.shortest(n)), n + 1, dtype=np.int64)
    lengths = lengths[lengths > 0]
    many = b.edits(lengths) + b.spare(lengths)
    bands = b.band(lengths)
    wide = np.concatenate([np.stack([lengths // many, bands]), np.stack([lengths // many + (lengths % many > 0), bands])], axis=1)
    hash_of, keys, places = Windows(c), [], []
    for w, band in np.unique(wide, axis=1).T.tolist():
        if not 0 < w <= n or only not in (None, band):
            continue
        q = np.arange(n - w + 1)
        h = hash_of.hashes(q, w)
        reach = int(b.reach(np.int64(band)))
        size = 2 * reach + 1
        low, high = np.maximum(q - reach, 0) // size, (q + reach) // size
        for at, bucket in ((slice(None), low), (high > low, high)):
            key, place = _key(h[at], w, band, bucket[at]), q[at]
            if bits is not None:
                hit = bits[(key >> np.uint64(67 - SKETCH_BITS)).astype(np.int64)] >> (key >> np.uint64(64 - SKETCH_BITS) & np.uint64(7)).astype(np.uint8) & 1
                key, place = key[hit == 1], place[hit == 1]
            keys.append(key)
            places.append(place)
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _flat(batch: pa.RecordBatch, per_text: list[tuple], kinds: list) -> pa.RecordBatch:
    """Rows (id, length, ...) of the arrays found for each text of a batch."""
    many = [len(x[0]) for x in per_text]
    who = pa.array(np.repeat(np.arange(len(per_text)), many))
    columns = [pa.array(np.concatenate([np.broadcast_to(np.asarray(x[k]), m) for x, m in zip(per_text, many)]).astype(t))
               for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(2).take(who), *columns],
                                      names=["id", "n", "key", *[f"c{k}" for k in range(1, len(kinds))]])


def _in_batches(batch: pa.RecordBatch, find, kinds: list, rows: int = 1 << 20):
    """``find`` of every text, given out in batches of about ``rows`` rows."""
    held, start, size = [], 0, 0
    texts = batch.column(1).to_pylist()
    for k, text in enumerate(texts):
        held.append(find(text))
        size += len(held[-1][0])
        if size >= rows or k == len(texts) - 1:
            yield _flat(batch.slice(start, k + 1 - start), held, kinds)
            held, start, size = [], k + 1, 0


def segments(strings: DataFrame, b: Budget, counts=None) -> DataFrame:
    """(key, s_id, s_len, i, p, s_k, m) of ``strings`` (id, s, n); ``counts``: a
    broadcast of ``frequencies``."""
    kind = strings.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield from _in_batches(batch, lambda text: text_segments(text, b, counts and counts.value), [np.int64, np.int32, np.int32, np.int32, np.int32])
    out = strings.mapInArrow(run, f"id {kind}, n long, key long, c1 int, c2 int, c3 int, c4 int")
    return out.withColumnsRenamed({"id": "s_id", "n": "s_len", "c1": "i", "c2": "p", "c3": "s_k", "c4": "m"})


def windows(strings: DataFrame, b: Budget, bits) -> DataFrame:
    """(key, r_id, r_len, q) of the windows that the bitmap lets through."""
    kind = strings.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield from _in_batches(batch, lambda text: text_windows(text, b, bits.value), [np.int64, np.int32])
    out = strings.mapInArrow(run, f"id {kind}, n long, key long, c1 int")
    return out.withColumnsRenamed({"id": "r_id", "n": "r_len", "c1": "q"})


def frequencies(index: DataFrame) -> np.ndarray:
    """Number of segments by the first bits of their key; what is collected has
    2^COUNT_BITS rows at most."""
    rows = index.groupBy(F.shiftrightunsigned("key", 64 - COUNT_BITS).alias("w")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    found = np.zeros(1 << COUNT_BITS, np.int64)
    found[np.asarray(rows.column("w"))] = np.asarray(rows.column("n"))
    return found


def sketch(index: DataFrame) -> np.ndarray:
    """The bitmap of the index's keys, as bytes.  Bits are merged by 64 in the
    executors; what is collected has 2^(SKETCH_BITS - 6) rows at most."""
    word = F.shiftrightunsigned("key", 64 - SKETCH_BITS + 6)
    bit = F.shiftrightunsigned("key", 64 - SKETCH_BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = index.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).toArrow()
    found = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
    found[np.asarray(rows.column("w"))] = np.asarray(rows.column("b"))
    return found.view(np.uint8)


#: Bins of the character counts that two texts are compared by first.
BINS = 16


def with_bins(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s, n, bins): how many of a text's characters fall in each bin.  An
    edit changes one count by one."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("s"), F.length(text_col).cast("long").alias("n"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [np.bincount((codes(t or "") * np.uint64(0x9E3779B1) >> np.uint64(7) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).tolist()
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["id", "s", "n", "bins"])
    return rows.mapInArrow(run, f"id {kind}, s string, n long, bins array<int>")


def candidate_pairs(strings: DataFrame, id_col: str, text_col: str, threshold: int = 95) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair that reaches the threshold, and some
    that don't.  Equal texts should be merged before; empty and null texts are in
    no pair."""
    spark = strings.sparkSession
    b = Budget(int(threshold))
    base = (strings.select(F.col(id_col).alias("id"), F.col(text_col).alias("s"))
                   .withColumn("n", F.length("s").cast("long")).where("n > 0")
                   .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))
    path = scratch_path(spark, "fuzzy")
    counts = spark.sparkContext.broadcast(frequencies(segments(base, b).select("key")))
    segments(base, b, counts).write.parquet(path)
    index = spark.read.parquet(path)
    bits = spark.sparkContext.broadcast(sketch(index.select("key")))
    met = (windows(base, b, bits).join(index.hint("merge"), "key")
           .where((F.col("s_id") != F.col("r_id")) & (F.col("s_len") <= F.col("r_len"))
                  & (F.col("r_len") * b.t <= F.col("s_len") * (200 - b.t))
                  & (F.abs(F.col("q") - F.col("p")) <= F.col("s_k"))))
    return (met.groupBy("s_id", "r_id", "i").agg(F.first("m").alias("m"))
               .groupBy("s_id", "r_id").agg(F.count(F.lit(1)).alias("hits"), F.first("m").alias("m"))
               .where("hits >= m")
               .select(F.least("s_id", "r_id").alias("id_a"), F.greatest("s_id", "r_id").alias("id_b")).distinct())
