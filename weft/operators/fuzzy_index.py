"""J7 inside a block: which texts may be similar to which (lossless).

A pair with lengths |s| <= |r| that reaches t % has D = (100 - t)(|s| + |r|) / 100
indels at most, of which (D - |r| + |s|) / 2 at most are characters of s alone and
(D + |r| - |s|) / 2 at most characters of r alone.

* ``Chunks``: s is cut into chunks of one width, as wide as leaves some more than the
  edits of its longest partner.  The most frequent ones that are left over are not
  indexed; of the others all but D stand in r, shifted to the left by s's own
  characters at most and to the right by r's.  The key hashes a chunk with the bucket
  of its place; a chunk has a key for each bucket where it may stand (two at most), so
  that a window of r is looked up once.
* ``near_short``: texts of 64 characters at most.  An indel changes one bit of a text's
  signature (the parities of its letters' counts, or the counts modulo four in Gray
  code), so the signatures of all pairs are compared, a machine word each, and who
  differs in D bits at most goes through the band of the table of edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weft.operators.fuzzy import Budget

#: Widest chunk; counts of the frequency table (a power of two).
WIDEST, COUNT_BITS = 8, 20
#: Characters hashed at once; rows that windows and chunks make at once.
_CHARS, _ROWS = 1 << 18, 1 << 20
_B = 0x100000001B3


def spelt(texts: list[str]) -> np.ndarray:
    """Code points of all texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most``, or single ones above it."""
    ends = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        done = ends[k] - sizes[k]
        j = max(k + 1, int(np.searchsorted(ends, done + most, "right")))
        yield k, j
        k = j


def grams(c: np.ndarray, w: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of every window of ``w`` characters."""
    one = c.astype(np.uint64) + np.uint64(1)
    h, k = one, 1
    with np.errstate(over="ignore"):
        for bit in bin(w)[3:]:
            h = h[:max(0, len(h) - k)] * np.uint64(pow(_B, k, 1 << 64)) + h[k:]
            k *= 2
            if bit == "1":
                h = h[:max(0, len(h) - 1)] * np.uint64(_B) + one[k:]
                k += 1
    return h


def _mixed(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def chunk_width(n: np.ndarray, b: Budget) -> int:
    """The widest chunks that leave all texts some more than their edits; 0 if none do."""
    k = b.edits(n)
    return next((w for w in range(WIDEST, 0, -1) if (n // w - k >= np.maximum(3, k // 20)).all()), 0)


class Chunks:
    """Chunks of texts in the order of their keys."""

    def __init__(self, texts: list[str], b: Budget):
        self.t = b.t
        self.n = n = np.array([len(x) for x in texts], np.int64)
        edits, longest = b.edits(n), b.longest(n)
        left, right = (100 - b.t) * 2 * n // 100 // 2, (edits + longest - n) // 2
        self.w = w = chunk_width(np.unique(n), b)
        self.bucket = int((left + right).max()) + 1
        self.kept = np.zeros(len(n), np.int64)
        if not w:
            return
        many = n // w
        self.kept = np.minimum(many, edits + np.maximum(3, edits // 20))
        owner = np.repeat(np.arange(len(n), dtype=np.int32), many)
        place = ((np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * w).astype(np.int32)
        h = np.empty(len(owner), np.uint64)
        chunk_ends = np.cumsum(many)
        for k, j in runs(n, _CHARS):
            at = slice(int(chunk_ends[k] - many[k]), int(chunk_ends[j - 1]))
            starts = np.cumsum(n[k:j]) - n[k:j]
            h[at] = grams(spelt(texts[k:j]), w)[starts[owner[at] - k] + place[at]]
        stay = self._rarest(h, owner, many)
        h, owner, place = h[stay], owner[stay], place[stay]
        del stay
        low = np.maximum(place - left.astype(np.int32)[owner], 0) // np.int32(self.bucket)
        two = (place + right.astype(np.int32)[owner]) // np.int32(self.bucket) > low
        keys = np.concatenate([_mixed(h, low), _mixed(h[two], low[two] + 1)])
        del h, low
        order = np.argsort(keys)
        keys, two = keys[order], np.flatnonzero(two).astype(np.int32)
        self.owner = np.concatenate([owner, owner[two]])[order]
        self.place = np.concatenate([place, place[two]])[order]
        del owner, place, two, order
        self.size = max(8, len(keys).bit_length() + 1)
        self.mark = keys.astype(np.uint32)
        self.start = np.zeros((1 << self.size) + 1, np.int32)
        self.bits = np.zeros(1 << self.size, np.uint8)
        for k in range(0, len(keys), _ROWS):
            at = _top(keys[k:k + _ROWS], self.size + 3)
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            np.add.at(self.start, (at >> 3) + 1, np.int32(1))
        np.cumsum(self.start, out=self.start)

    def _rarest(self, h: np.ndarray, owner: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Places of the chunks that are indexed: of each text the rarest ones."""
        slot = (_mixed(h, np.zeros(1)) >> np.uint64(64 - COUNT_BITS)).astype(np.int32)
        often = np.bincount(slot, minlength=1 << COUNT_BITS)[slot]
        del slot
        order = np.argsort(owner.astype(np.int64) << 32 | np.minimum(often, (1 << 31) - 1), kind="stable")
        del often
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return np.sort(order[rank < np.repeat(self.kept, many)])

    def budget(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Indels that a similar pair of the texts ``s`` and texts of length n has at most."""
        return (100 - self.t) * (self.n[s] + n) // 100

    def _windows(self, texts: list[str], n: np.ndarray):
        """(text, place, key) of the windows that may meet a chunk."""
        starts = np.cumsum(n) - n
        h = grams(spelt(texts), self.w)
        q = (np.arange(int(n.sum())) - np.repeat(starts, n)).astype(np.int32)[:len(h)]
        key = _mixed(h, q // np.int32(self.bucket))
        at = _top(key, self.size + 3)
        hit = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        r = np.searchsorted(starts, hit, "right") - 1
        inside = q[hit] + self.w <= n[r]
        hit, r = hit[inside], r[inside]
        return r, q[hit], key[hit]

    def _met(self, n: np.ndarray, r: np.ndarray, q: np.ndarray, key: np.ndarray, low: np.ndarray, many: np.ndarray):
        """The pair wherever a window meets a chunk, ``_ROWS`` at a time: its text looked
        up times the texts indexed, plus its text indexed."""
        mark = key.astype(np.uint32)
        for k, j in runs(many, _ROWS):
            some = many[k:j]
            who = np.repeat(np.arange(k, j), some)
            at = np.arange(len(who)) + np.repeat(low[k:j] - (np.cumsum(some) - some), some)
            same = self.mark[at] == mark[who]
            at, who = at[same], who[same]
            s, place = self.owner[at], self.place[at]
            longer = n[r[who]] - self.n[s]
            edits = (100 - self.t) * (longer + 2 * self.n[s]) // 100
            shift = 2 * (q[who] - place)
            good = (longer >= 0) & (edits >= longer) & (shift >= longer - edits) & (shift <= longer + edits)
            yield r[who[good]] * len(self.n) + s[good]

    def sharing(self, texts: list[str]) -> Iterator[tuple]:
        """(s, r, times), places in the texts indexed and in ``texts``: who shares as many
        chunks as a similar text of its length, and how many.  A window that stands in a
        text twice counts twice, which only adds candidates."""
        n = np.array([len(x) for x in texts], np.int64)
        whole = len(self.n)
        for k, j in runs(n, _CHARS) if self.w else ():
            r, q, key = self._windows(texts[k:j], n[k:j])
            slot = _top(key, self.size)
            low = self.start[slot].astype(np.int64)
            many = self.start[slot + 1] - low
            rows = np.bincount(r, many, minlength=j - k).astype(np.int64)
            for x, y in runs(rows, 2 * _ROWS):
                at, room = slice(*np.searchsorted(r, [x, y]).tolist()), whole * (y - x)
                met = self._met(n[k + x:k + y], r[at] - x, q[at], key[at], low[at], many[at])
                if 4 * int(rows[x:y].sum()) > room:
                    times = np.zeros(room, np.int64)
                    for pair in met:
                        times += np.bincount(pair, minlength=room)
                    some = np.flatnonzero(times)
                    times = times[some]
                else:
                    some, times = np.unique(np.concatenate([np.zeros(0, np.int64), *met]), return_counts=True)
                s, r_ = some % whole, k + x + some // whole
                good = times >= self.kept[s] - self.budget(s, n[r_])
                yield s[good], r_[good], times[good]
        for k in () if self.w else range(len(n)):
            s = np.flatnonzero((n[k] >= self.n) & (self.budget(np.arange(whole), n[k]) >= n[k] - self.n))
            yield s, np.full(len(s), k), np.zeros(len(s), np.int64)


def signatures(texts: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signature a text, and its letters by number (0 behind its end)."""
    parts = list(runs(n, _CHARS))
    often = np.zeros(0x110000, np.int64)
    for k, j in parts:
        often += np.bincount(spelt(texts[k:j]), minlength=len(often))
    letters = np.flatnonzero(often)
    number = np.zeros(len(often), np.int32)
    number[letters] = np.arange(1, len(letters) + 1)
    rows = np.zeros((len(n), int(n.max())), np.uint8 if len(letters) < 256 else np.uint16 if len(letters) < 65536 else np.uint32)
    words = np.zeros(len(n), np.uint64)
    bit = np.arange(len(letters)) % 64
    second = np.zeros(0, np.int64)
    for k, j in parts:
        c = number[spelt(texts[k:j])]
        who = np.repeat(np.arange(j - k), n[k:j])
        rows[who + k, np.arange(len(c)) - np.repeat(np.cumsum(n[k:j]) - n[k:j], n[k:j])] = c
        if len(letters) > 64:
            np.bitwise_xor.at(words, who + k, np.uint64(1) << bit[c - 1].astype(np.uint64))
            continue
        counts = np.bincount(who * len(letters) + c - 1, minlength=(j - k) * len(letters)).reshape(j - k, len(letters))
        if not k:
            # Two bits for the letters whose counts differ most, as far as there are bits.
            second = np.argsort(-counts.var(axis=0), kind="stable")[:64 - len(letters)]
        gray = counts ^ counts >> 1
        one = counts & 1
        one[:, second] = gray[:, second] & 1
        words[k:j] = (one.astype(np.uint64) << bit.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        words[k:j] |= ((gray[:, second] >> 1 & 1).astype(np.uint64) << (len(letters) + np.arange(len(second))).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    return words, rows


def indels(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Indel distances of the rows of ``a`` to those of ``b`` that are no longer, where
    they are ``most`` (below 100) or less; else a number above it."""
    la, lb = a.shape[1], b.shape[1]
    own, other = (most + la - lb) // 2, (most - la + lb) // 2
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(a.shape[1], 200, np.uint8)
    row = {j: np.full(a.shape[1], j, np.uint8) for j in range(min(other, lb) + 1)}
    for i in range(1, la + 1):
        last, row = row, {}
        for j in range(max(0, i - own), min(lb, i + other) + 1):
            if not j:
                row[j] = np.full(a.shape[1], i, np.uint8)
                continue
            row[j] = np.minimum(last.get(j, far), row.get(j - 1, far)) + np.uint8(1)
            if j - 1 in last:
                row[j] = np.minimum(row[j], np.where(a[i - 1] == b[j - 1], last[j - 1], far))
    return row[lb]


def near_short(texts: list[str], order: np.ndarray, indexed: int, probes: np.ndarray, t: int) -> tuple:
    """(s, r, lcs), as places in ``texts``: similar pairs of one of the first ``indexed``
    texts and a text of ``probes`` that is longer, or as long and later in ``order``."""
    n = np.array([len(x) for x in texts], np.int64)
    words, rows = signatures(texts, n)
    out = [(np.zeros(0, np.int64),) * 3]
    by_length = [{int(x): at[n[at] == x] for x in np.unique(n[at])} for at in (np.arange(indexed), np.asarray(probes))]
    for lr, r in by_length[1].items():
        for ls, s in by_length[0].items():
            most = (100 - t) * (ls + lr) // 100
            most -= (most - lr + ls) % 2
            if ls > lr or most < lr - ls or most == 0:
                continue
            held, size, mine = [], 0, words[s]
            tile = max(1, (1 << 18) // len(s))
            for k in range(0, len(r), tile):
                i, j = np.nonzero(np.bitwise_count(mine ^ words[r[k:k + tile]][:, None]) <= most)
                if ls == lr:
                    later = order[s[j]] < order[r[k + i]]
                    i, j = i[later], j[later]
                held.append((s[j], r[k + i]))
                size += len(j)
                if size and (size >= 1 << 16 or k + tile >= len(r)):
                    one, other = map(np.concatenate, zip(*held))
                    for x in range(0, size, 1 << 16):
                        a, c = other[x:x + (1 << 16)], one[x:x + (1 << 16)]
                        edits = indels(rows[a, :lr], rows[c, :ls], most)
                        good = edits <= most
                        out.append((c[good], a[good], (ls + lr - edits[good].astype(np.int64)) // 2))
                    held, size = [], 0
    return tuple(map(np.concatenate, zip(*out)))
