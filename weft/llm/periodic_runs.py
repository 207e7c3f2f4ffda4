"""Periodic runs of words, by recompression.

A run is a maximal stretch of words with smallest period q that is at least
``min_words`` and 2 q long.  The words of some texts (each between separators of
its own) form one sequence, which is compressed in rounds until one symbol is
left: *blocks* of one symbol become one symbol, then *pairs* of a left and a
right symbol (sides are drawn by hashing the symbol) become one.  Every round is
a function of the symbols alone, so equal stretches get equal phrases but for
their edges, and the rounds are a run-length grammar of the sequence.

The longest common extension of two places climbs that grammar: while both
stand at the edge of a phrase they go up a round; otherwise one step (of a
symbol, or of the shorter rest of a block) brings both to an edge or shows that
they differ; after that they go down again with one step a round at most.  So an
extension costs a constant number of steps a round, all queries of a round
being done together.

A run of period p holds max(p, min_words - p) places in a row at which the word
p later is the same; so for each p only every so many-th place is a candidate
(a harmonic number of them), and its exact run is found by one extension to the
right and one to the left.  Multiples of a run's period end at the same bounds,
so of each pair of bounds the least period is kept.

Memory: texts are worked on in slices of ``slice_bytes`` (a longer text alone),
some 200 bytes a word; candidates are tried ``_TRIED`` at a time.  Nothing is
shuffled.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb
from weft.llm.words import Words, split

#: Bytes of text whose grammar is held in memory together, and candidates tried together.
SLICE_BYTES, _TRIED = 1 << 20, 1 << 20


@dataclasses.dataclass
class _Round:
    symbols: np.ndarray      # of this round, n of them
    edge: np.ndarray         # n + 1: a phrase begins here
    phrase: np.ndarray       # n + 1: number of the phrase that holds (at n: their number)
    first: np.ndarray        # where each phrase begins, and n
    block: bool


def _round(symbols: np.ndarray, edge: np.ndarray, block: bool) -> _Round:
    first = np.flatnonzero(edge).astype(np.int32)
    phrase = np.cumsum(edge, dtype=np.int32)
    phrase -= 1
    return _Round(symbols, edge, phrase, first, block)


class Grammar:
    """Rounds of block and pair compression of a sequence that starts and ends
    with symbols that stand nowhere else."""

    def __init__(self, symbols: np.ndarray):
        s = symbols.astype(np.int32)
        fresh = int(s.max(initial=-1)) + 1
        self.rounds: list[_Round] = []
        draw = 0
        while len(s) > 1:
            edge = np.ones(len(s) + 1, bool)
            edge[1:-1] = s[1:] != s[:-1]
            if not edge.all():
                s, fresh = self._renamed(_round(s, edge, True), fresh)
                continue
            # No two neighbours are equal now; about a quarter of them are (left, right).
            draw += 1
            mixed = (s.astype(np.uint64) + np.uint64(draw << 33)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            right = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)
            edge[1:-1] = right[:-1] | ~right[1:]
            if not edge.all():
                s, fresh = self._renamed(_round(s, edge, False), fresh)

    def _renamed(self, r: _Round, fresh: int) -> tuple[np.ndarray, int]:
        """The phrases as symbols: those of one symbol keep it, equal others share a new one."""
        self.rounds.append(r)
        size = np.diff(r.first)
        out = r.symbols[r.first[:-1]]
        long = np.flatnonzero(size > 1)
        a = r.first[long]
        second = size[long] if r.block else r.symbols[a + 1]
        key = r.symbols[a].astype(np.int64) << 32 | second.astype(np.int64)
        distinct, number = np.unique(key, return_inverse=True)
        out[long] = fresh + number
        return out, fresh + len(distinct)

    def extend(self, i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
        """For each pair of different places the number of equal symbols from
        there on (``left``: before them, going left)."""
        i, j = i.astype(np.int32), j.astype(np.int32)
        look, way = (1, -1) if left else (0, 1)
        who, a, b = np.arange(len(i)), i, j
        differ: list[tuple] = []
        for r in self.rounds:
            same = r.symbols[a - look] == r.symbols[b - look]
            out = [(who[~same], a[~same], b[~same])]
            who, a, b = who[same], a[same], b[same]
            move = np.flatnonzero(~(r.edge[a] & r.edge[b]))
            if len(move):
                step = 1
                if r.block:
                    step = np.minimum(self._rest(r, a[move], left), self._rest(r, b[move], left))
                a[move] += way * step
                b[move] += way * step
                if r.block:                      # blocks of unequal rest end here
                    on = r.edge[a] & r.edge[b]
                    out.append((who[~on], a[~on], b[~on]))
                    who, a, b = who[on], a[on], b[on]
            differ.append(tuple(map(np.concatenate, zip(*out))))
            if not len(who):
                break
            a, b = r.phrase[a], r.phrase[b]
        who, a, b = differ.pop() if differ else (who, a, b)
        for r, (more, c, d) in zip(reversed(self.rounds[:len(differ)]), reversed(differ)):
            # The phrases differ: their symbols do too, or after one of them (or the shorter block).
            size_a, size_b = np.abs(r.first[a + way] - r.first[a]), np.abs(r.first[b + way] - r.first[b])
            a, b = r.first[a], r.first[b]
            same = r.symbols[a - look] == r.symbols[b - look]
            step = np.where(same, np.minimum(size_a, size_b) if r.block else 1, 0).astype(np.int32)
            who, a, b = (np.concatenate(x) for x in ((who, more), (a + way * step, c), (b + way * step, d)))
        found = np.zeros(len(i), np.int64)
        found[who] = np.abs(a - i[who])
        return found

    @staticmethod
    def _rest(r: _Round, at: np.ndarray, left: bool) -> np.ndarray:
        """Symbols of at's phrase from there on (left: before it)."""
        return at - r.first[r.phrase[at - 1]] if left else r.first[r.phrase[at] + 1] - at


def find_runs(codes: np.ndarray, offsets: np.ndarray, min_words: int = 12) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of the texts' words, by text,
    start, period."""
    n = np.diff(offsets)
    texts = len(n)
    none = (np.zeros(0, np.int64),) * 4
    if not len(codes) or n.max() < max(min_words, 2):
        return none
    # Separator, words, separator, words, ..., separator.
    alphabet = int(codes.max()) + 1
    place = np.arange(len(codes)) + np.repeat(np.arange(texts), n) + 1
    seq = np.empty(len(codes) + texts + 1, np.int32)
    base = offsets[:-1] + np.arange(texts) + 1
    seq[np.append(base - 1, len(seq) - 1)] = alphabet + np.arange(texts + 1)
    seq[place] = codes
    grammar = Grammar(seq)

    periods = np.where(n >= min_words, n // 2, 0)
    total = int(periods.sum())
    found = []
    done = 0
    # (text, period) pairs in turn, as many as have _TRIED candidates.
    bounds = np.append(0, np.cumsum(periods))
    while done < total:
        upto = min(total, done + _TRIED)
        pair = np.arange(done, upto)
        text = np.searchsorted(bounds, pair, "right") - 1
        p = pair - bounds[text] + 1
        gap = np.maximum(p, min_words - p)
        many = (n[text] - p - 1) // gap + 1
        ends = np.cumsum(many)
        take = max(1, int(np.searchsorted(ends, _TRIED, "right")))
        done += take
        text, p, gap, many = text[:take], p[:take], gap[:take], many[:take]
        begin = np.append(0, np.cumsum(many))
        for lo in range(0, int(begin[-1]), _TRIED):         # one pair of a very long text may have more
            hi = min(int(begin[-1]), lo + _TRIED)
            who = np.repeat(np.arange(take), np.minimum(begin[1:], hi).clip(lo) - np.minimum(begin[:-1], hi).clip(lo))
            i = base[text[who]] + (np.arange(lo, hi) - begin[who]) * gap[who]
            hit = np.flatnonzero(seq[i] == seq[i + p[who]])
            who, i = who[hit], i[hit]
            q = p[who]
            after = grammar.extend(i, i + q)
            before = grammar.extend(i, i + q, left=True)
            length = before + after + q
            good = (length >= np.maximum(min_words, 2 * q)) & (before < gap[who])
            found.append((text[who[good]], i[good] - before[good], length[good], q[good]))
    text, start, length, q = map(np.concatenate, zip(*found)) if found else none
    order = np.lexsort((q, length, start))
    text, start, length, q = text[order], start[order], length[order], q[order]
    least = np.ones(len(q), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[least], start[least], length[least], q[least]
    order = np.lexsort((q, start))
    text, start, length, q = text[order], start[order], length[order], q[order]
    return text, start - base[text], length, q


def collapsed(words: Words, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """The texts' words without those of a run after its first period, one space
    between them."""
    text, start, length, q = runs
    depth = np.zeros(len(words.codes) + 1, np.int64)
    at = words.offsets[text] + start
    np.add.at(depth, at + q, 1)
    np.add.at(depth, at + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    upto = np.append(0, np.cumsum(kept))[words.offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), words.words.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text",
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of ``docs``: its runs by start,
    then period (``start`` is a word's number from 0), and its text without the
    repetitions.

    A null or empty text has no words, no runs and collapses to an empty text;
    texts of any length are read whole; repeated rows get a row each and equal
    results; null ids stay; an empty table gives an empty one; further columns
    are not read, so their names don't matter."""
    def run(batches):
        for batch in batches:
            texts = wb.text_array(batch.column(1))
            for a, m in wb.slices(texts, slice_bytes):
                words = split(texts.slice(a, m))
                runs = find_runs(words.codes, words.offsets, min_words)
                ends = np.searchsorted(runs[0], np.arange(m + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs[1:]], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(np.diff(words.offsets), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), collapsed(words, runs)],
                    names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(wb.trimmed(run), f"id {kind}, n_words long, "
                          "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where each tenth document (h = crc32 of its id as text leaves 0
    modulo 10) repeats a part of itself: with g = floor(h / 10), every word from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    The words of such a text are joined by single spaces.  Texts without words and
    rows with a null id stay."""
    bare = F.btrim(F.col(text_col), F.lit(" \t\n\x0b\f\r"))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.split(bare, "[ \\x09-\\x0D]+")
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    a, p, rest = a.cast("int"), p.cast("int"), (n - a).cast("int")
    part = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(part, F.lit(1), rest)), " ")
    return docs.withColumn(text_col, F.when((F.pmod(h, F.lit(10)) == 0) & (bare != ""), repeated).otherwise(F.col(text_col)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of ``periodic_runs``: the number of runs, the longest
    of them (then the least start, then the least period), hashes of all runs and
    of the collapsed text."""
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return (found.withColumn("top", top).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"), F.expr("1000 * top.l div -top.p").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"))
