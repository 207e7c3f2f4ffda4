"""Word-cached encoding with a ``tokenizers`` BPE file (runs inside tasks).

The pipeline of ``word_bpe_49k.json`` never lets a token cross ASCII white
space: its normaliser (NFC, white-space runs to one space, lower case) and its
pre-tokeniser (runs of letters, single digits, runs of other signs, white space
removed) work on each word between ASCII white space alone.  So a text's ids
are the concatenated ids of its words, and a word's ids can be kept.

* Splitting a batch into words and finding its distinct words is Arrow code.
* A distinct word that is not yet known is cut into pre-tokens by the same
  pattern and each pre-token goes through the library's own BPE model.  That
  direct route is only taken for words of ASCII and Latin letters and signs
  (below U+0180), where lower-casing and the letter/number classes are plain
  tables; every other word goes through the library's whole ``encode``.
* A text with a ``<|`` goes through the whole ``encode`` as a whole, because
  special strings are matched in the raw text.

Memory is bounded: when the cache holds ``max_words`` words, only those of the
batch at hand stay in it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: End of the range of the direct route.  U+0130 lower-cases to two characters.
_LATIN_END, _LATIN_SKIP = 0x180, {0x130}
#: Words of one slice of a batch are held in memory together: bytes of text in it.
SLICE_BYTES = 8 << 20


def _latin_classes() -> tuple[str, str, str]:
    """(characters of the direct route, its letters, its numbers) as regex classes."""
    every, letters, numbers = [], [], []
    for c in range(0x21, _LATIN_END):
        ch = chr(c)
        if c in _LATIN_SKIP or ch.isspace() or unicodedata.category(ch) in ("Cc", "Cf"):
            continue
        if not unicodedata.is_normalized("NFC", ch):
            continue
        every.append(ch)
        kind = unicodedata.category(ch)[0]
        if kind == "L":
            letters.append(ch)
        elif kind == "N":
            numbers.append(ch)
    esc = lambda xs: "".join(re.escape(x) for x in xs)
    return esc(every), esc(letters), esc(numbers)


_EVERY, _LETTERS, _NUMBERS = _latin_classes()
_DIRECT = re.compile(f"[{_EVERY}]+")
#: The file's pre-token pattern over the direct route's characters.
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def byte_characters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level
    vocabulary: printable bytes stand for themselves, the others get the
    characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(printable))
    return table


_BYTE_CHARS = byte_characters()


def byte_level(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS)


class Encoded:
    """Ids of a run of texts: ``ids[offsets[i]:offsets[i + 1]]`` are text i's."""

    __slots__ = ("offsets", "ids")

    def __init__(self, offsets: np.ndarray, ids: np.ndarray):
        self.offsets, self.ids = offsets, ids


class WordBPE:
    """One per Python worker; see the module's docstring."""

    def __init__(self, tokenizer_json: str, max_words: int = 500_000):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_str(tokenizer_json)
        self.model = self.full.model
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.pre: dict[str, list[int]] = {}

    # -- one word ---------------------------------------------------------
    def _plain(self, p: str) -> list[int]:
        return [t.id for t in self.model.tokenize(byte_level(p))]

    def pretoken(self, p: str) -> list[int]:
        """Ids of a part of a word; a part that is a known word is not kept again."""
        at = self.slot.get(p)
        if at is not None:
            return self._ids(at)
        got = self.pre.get(p)
        if got is None:
            got = self.pre[p] = self._plain(p)
        return got

    def word(self, w: str) -> list[int]:
        """Ids of one word without ASCII white space and without ``<|``."""
        if _DIRECT.fullmatch(w):
            found = _PRETOKEN.findall(w.lower())
            if len(found) == 1:
                # The word itself is kept by its slot.
                return self.pre.get(found[0]) or self._plain(found[0])
            return [i for p in found for i in self.pretoken(p)]
        return self.full.encode(w, add_special_tokens=False).ids

    def _ids(self, at: int) -> list[int]:
        start = self.starts[at]
        return self.pool[start:start + self.counts[at]].tolist()

    def _add(self, words: list[str]) -> None:
        """Give every word that is new a slot."""
        self._store(words, [self.word(w) for w in words])

    def _store(self, words: list[str], fresh: list[list[int]]) -> None:
        n = len(self.slot)
        lens = np.fromiter(map(len, fresh), np.int32, len(fresh))
        flat = np.fromiter((i for ids in fresh for i in ids), np.uint32, int(lens.sum()))
        while n + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.counts[n:n + len(words)] = lens
        self.starts[n:n + len(words)] = self.used + np.cumsum(lens) - lens
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.update(zip(words, range(n, n + len(words))))

    def _keep(self, words: list[str]) -> None:
        """Empties the cache but for those of ``words`` that it has, so that
        common words are not encoded again."""
        known = [w for w in words if w in self.slot]
        ids, pre = [self._ids(self.slot[w]) for w in known], self.pre
        self._reset()
        self._store(known, ids)
        if len(pre) <= self.max_words // 4:
            self.pre = pre

    def slots(self, distinct: list[str]) -> np.ndarray:
        """Slots of a batch's distinct words; new words are encoded first."""
        get = self.slot.get
        new = [w for w in distinct if get(w) is None]
        if new:
            if len(self.slot) and len(self.slot) + len(new) > self.max_words:
                self._keep(distinct)
                get = self.slot.get
                new = [w for w in distinct if get(w) is None]
            if len(self.pre) > self.max_words:
                self.pre = {}
            self._add(new)
        return np.fromiter(map(get, distinct), np.int64, len(distinct))

    # -- batches ----------------------------------------------------------
    def _split(self, texts: pa.Array):
        """(word offsets per text, slot of each word) of texts without ``<|``."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = np.asarray(words.offsets, np.int64)
        coded = words.flatten().dictionary_encode()
        slot = self.slots(coded.dictionary.to_pylist())
        return offsets - offsets[0], slot[np.asarray(coded.indices)] if len(slot) else np.zeros(0, np.int64)

    def _whole(self, texts: pa.Array) -> dict[int, list[int]]:
        """Ids of the texts that hold ``<|``, by their position."""
        at = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|").cast(pa.uint8())))
        return {int(i): self.full.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in at}

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of every text (null: none)."""
        texts = pc.fill_null(texts, "")
        whole = self._whole(texts)
        if whole:
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        offsets, slot = self._split(texts)
        n = self.counts[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        total = int(ends[-1])
        ids = self.pool[np.repeat(self.starts[slot] - ends[:-1], n) + np.arange(total)]
        bounds = ends[offsets]
        if whole:
            parts, lens = [], np.diff(bounds)
            for i in range(len(texts)):
                part = np.asarray(whole[i], np.uint32) if i in whole else ids[bounds[i]:bounds[i + 1]]
                lens[i] = len(part)
                parts.append(part)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)])
        return Encoded(bounds, ids)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, length) runs of texts of about ``limit`` bytes, one text at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    run = np.cumsum(size) // max(1, limit)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(size)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return column


#: One encoder per Python worker, kept between its tasks.
_HELD: dict[str, object] = {}


def held(kind: str, key: int, make):
    """The worker's object of this kind for a broadcast with id ``key``."""
    name = f"{kind}:{key}"
    if name not in _HELD:
        for k in [k for k in _HELD if k.startswith(f"{kind}:")]:
            del _HELD[k]
        _HELD[name] = make()
    return _HELD[name]


def trimmed(task):
    """A task function that leaves nothing in its Python worker: held encoders
    go before it starts, and freed memory is given back when it ends (workers
    stay alive between stages, beside the JVM of the next one)."""
    def run(batches):
        _HELD.clear()
        try:
            yield from task(batches)
        finally:
            gc.collect()
            give_back()
    return run


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tokenizer_json(path: str) -> str:
    """The vocabulary file's text.  Its size is the vocabulary's, so it may be
    broadcast whatever the size of the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def key_of(text: str | bytes) -> int:
    import zlib
    return zlib.crc32(text.encode() if isinstance(text, str) else text)
