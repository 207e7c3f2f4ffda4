"""SentencePiece encoding with source spans, and decoding.

Normalisation is done here, with its alignment: at each place the longest
prefix that the model's compiled character map knows is replaced (a double
array of 32-bit units, walked byte by byte), any other character stands for
itself, spaces become U+2581, and every normalised byte remembers the source
byte it came from.  A piece covers a run of normalised bytes, so its source span
follows from the alignment.

Pieces come from the library.  No piece of the model reaches from a character
other than U+2581 into a following U+2581 (checked for each model), so a text's
pieces are those of its words, "U+2581 and what follows up to the next"; a
word's pieces are kept, in a cache that is emptied when full.  Models with an
identity map take the quick route: a text without U+2581 or double spaces is
split at its spaces.  All other texts and models are normalised first.

Spans are byte offsets in the UTF-8 text.  The U+2581 that the model puts before
a text covers nothing; bytes of a character outside the vocabulary cover one
byte each.

Results: a null or empty text has no pieces and decodes to the empty text; texts
of any length are encoded whole; repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb

MARK = "▁"


class CharacterMap:
    """The compiled map of a normaliser: longest-prefix lookup in UTF-8 bytes."""

    def __init__(self, blob: bytes):
        self.units = self.texts = None
        self.known: dict[str, tuple[int, bytes]] = {}
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
            self.texts = blob[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest known prefix at ``at``.

        A unit holds an offset to its children (bits 10 to 30, times 256 when
        bit 9 is set), whether a value hangs below it (bit 8) and its label
        (bits 0 to 7 and 31); a value is a place in the replacement texts."""
        if self.units is None:
            return None
        units, best = self.units, None
        offset = lambda u: u >> 10 << ((u & 1 << 9) >> 6)
        node = offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & (1 << 31 | 0xFF) != raw[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & (1 << 31) - 1
                best = (k + 1 - at, value)
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1]:end]


def _char_len(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """One per Python worker."""

    def __init__(self, model: bytes, max_words: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if not self.escape or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models without escaped spaces or with U+2581 at the end of pieces are not covered")
        kinds = pb.ModelProto.SentencePiece
        self.byte_ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        user = any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        crossing = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type != kinds.CONTROL)
        if user or crossing or not self.byte_ids:
            raise ValueError("a piece reaches over a word's end, or characters outside the vocabulary have no bytes")
        #: Bytes of a piece in the normalised text; bytes of a byte piece: 1.
        self.piece_bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        #: The same with U+2581 as the one source byte of a space.
        self.space_bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.replace(MARK, " ").encode())
                                     for p in proto.pieces], np.int64)
        # Words are encoded as they are: the same model, whose normaliser adds and changes nothing.
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        self.words = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: No piece but its byte holds a line end: lines are apart as well.
        self.lines_apart = not any("\n" in p.piece for p in proto.pieces)
        self.quick = self.map.units is None and self.prefix and not self.squeeze
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    # -- normalisation ------------------------------------------------------
    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised UTF-8, source byte of each of its bytes and, last, of its end)."""
        raw, mark = text.encode(), MARK.encode()
        out, source = bytearray(), []
        at, n = 0, len(raw)
        chunks = []                                    # (start, taken, replacement)
        while at < n:
            found = self.map.longest(raw, at)
            taken, put = found if found else (_char_len(raw[at]), raw[at:at + _char_len(raw[at])])
            chunks.append((at, taken, put))
            at += taken
        if self.squeeze:                               # spaces at both ends go, runs become one
            while chunks and chunks[0][2] in (b" ", b""):
                chunks.pop(0)
        if not chunks:
            return b"", np.zeros(1, np.int64)
        blank = self.squeeze
        if self.prefix:
            out += mark
            source += [chunks[0][0]] * len(mark)
        for start, taken, put in chunks:
            while blank and put.startswith(b" "):
                put = put[1:]
            for b in (put.replace(b" ", mark)):
                out.append(b)
                source.append(start)
            if put:
                blank = self.squeeze and put.endswith(b" ")
        end = chunks[-1][0] + chunks[-1][1]
        if self.squeeze:
            while out.endswith(mark) and len(out) >= len(mark):
                end = source[-len(mark)]
                del out[-len(mark):], source[-len(mark):]
        return bytes(out), np.asarray([*source, end], np.int64)

    # -- words ----------------------------------------------------------------
    def _word_ids(self, w: str) -> list[int]:
        if "\n" in w and self.lines_apart:
            out: list[int] = []
            for k, part in enumerate(w.split("\n")):
                if k:
                    out.append(self.byte_ids["<0x0A>"])
                if part:
                    out += self.words.encode(part)
            return out
        return self.words.encode(w)

    def _slots(self, distinct: list[str]) -> np.ndarray:
        get = self.slot.get
        new = [w for w in distinct if get(w) is None]
        if new:
            if self.slot and len(self.slot) + len(new) > self.max_words:
                self._reset()
                get, new = self.slot.get, distinct
            plain = [w for w in new if "\n" not in w]
            fresh = dict(zip(plain, self.words.encode(plain, num_threads=1) if plain else []))
            ids = [fresh[w] if w in fresh else self._word_ids(w) for w in new]
            n, lens = len(self.slot), np.fromiter(map(len, ids), np.int64, len(ids))
            while n + len(new) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.counts[n:n + len(new)], self.starts[n:n + len(new)] = lens, self.used + np.cumsum(lens) - lens
            self.pool[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
            self.slot.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(get, distinct), np.int64, len(distinct))

    def _gather(self, words: pa.Array, bounds: np.ndarray, mark: str = "") -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of runs of words, each with ``mark`` put before it."""
        if not len(words):
            return np.zeros(len(bounds), np.int64), np.zeros(0, np.int32)
        coded = words.dictionary_encode()
        slot = self._slots([mark + w for w in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]
        n = self.counts[slot]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.starts[slot] - ends[:-1], n) + np.arange(int(ends[-1]))]
        return ends[bounds], ids

    # -- batches ----------------------------------------------------------
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets per text, ids, begins, ends): pieces and their source spans."""
        texts = pc.fill_null(texts, "")
        if self.quick:
            odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
            odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
            slow = np.flatnonzero(np.asarray(odd.cast(pa.uint8()))).tolist()
        else:
            odd, slow = None, list(range(len(texts)))
        if not slow:
            return self._encode_quick(texts)
        keep = [i for i in range(len(texts)) if i not in set(slow)]
        parts: list = [None] * len(texts)
        if keep:
            offsets, *flat = self._encode_quick(texts.take(pa.array(keep)))
            for k, i in enumerate(keep):
                parts[i] = [x[offsets[k]:offsets[k + 1]] for x in flat]
        for i in slow:
            parts[i] = self._encode_slow(texts[i].as_py())
        offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
        return (offsets, *(np.concatenate([p[k] for p in parts]) for k in range(3)))

    def _encode_quick(self, texts: pa.Array):
        words = pc.split_pattern(texts, " ")
        bounds = np.asarray(words.offsets, np.int64)
        offsets, ids = self._gather(words.flatten(), bounds - bounds[0], MARK)
        # Source bytes: a space for each mark; the text's own first mark is no byte of it.
        ends = np.cumsum(self.space_bytes[ids])
        size = np.concatenate([[0], ends])
        base = np.repeat(size[offsets[:-1]] + 1, np.diff(offsets))
        return offsets, ids, np.maximum(size[:-1] - base, 0), ends - base

    def _encode_slow(self, text: str):
        raw, source = self.normalise(text)
        whole = raw.decode()
        words, at = [], 0
        while at < len(whole):                         # marks, then all up to the next mark
            k = at
            while k < len(whole) and whole[k] == MARK:
                k += 1
            nxt = whole.find(MARK, k)
            nxt = len(whole) if nxt < 0 else nxt
            words.append(whole[at:nxt])
            at = nxt
        _, ids = self._gather(pa.array(words, pa.string()), np.array([0, len(words)]))
        ends = np.cumsum(self.piece_bytes[ids])
        begins = source[ends - self.piece_bytes[ids]] if len(ids) else ends
        stops = source[ends] if len(ids) else ends
        return ids, begins, stops

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        flat, cut = ids.tolist(), offsets.tolist()
        return self.library.decode([flat[a:b] for a, b in zip(cut, cut[1:])]) if len(cut) > 1 else []


def _held(model: bytes):
    return wb.held("piece", wb.key_of(model), lambda: Codec(model))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends, decoded) of every row: pieces, their source spans
    and the text that the library decodes from the ids."""
    def columns(codec, texts):
        offsets, ids, begins, ends = codec.encode(texts)
        cut = pa.array(offsets.astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (ids, begins, ends)]
        return [*lists, pa.array(codec.decode(offsets, ids), pa.string())]
    return _run(docs, model_path, id_col, text_col, columns,
                "ids array<int>, begins array<int>, ends array<int>, decoded string")


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_bytes): digests of what
    ``encode`` gives, made where it is made.  ``spans_bytes`` is the number of
    source bytes that the pieces' spans cover."""
    def columns(codec, texts):
        offsets, ids, begins, ends = codec.encode(texts)
        strings = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.cast(pa.array(ids), pa.string()))
        joined = pc.binary_join(strings, ",")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        covered = np.diff(np.concatenate([[0], np.cumsum(ends - begins)])[offsets])
        return [pa.array(np.diff(offsets), pa.int64()), pa.array([sha(x) for x in joined.to_pylist()], pa.string()),
                pa.array([sha(x) for x in codec.decode(offsets, ids)], pa.string()), pa.array(covered, pa.int64())]
    return _run(docs, model_path, id_col, text_col, columns,
                "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_bytes long")


def _run(docs, model_path, id_col, text_col, columns, schema):
    """One narrow scan; the model file, of its vocabulary's size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        codec = _held(shared.value)
        for batch in batches:
            texts = wb.text_array(batch.column(1))
            for a, n in wb.slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), *columns(codec, texts.slice(a, n))], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
