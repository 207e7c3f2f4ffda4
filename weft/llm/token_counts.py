"""Token counts by the whole-token shortcut.

Offline (once, on the driver) every vocabulary string is put through the
library's model alone; those that come back as exactly one token, and that the
pre-tokeniser leaves in one piece, are *proven* whole tokens.  In a text a
pre-token that is in this table counts 1 without any merging; only the others
go through the merges, once for each distinct pre-token that a worker holds.

Results: a null or empty text has 0 tokens and 0 bytes and is not over the
limit; texts of any length are counted whole; repeated rows are each counted;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb


def prove_whole_tokens(tokenizer_text: str) -> list[str]:
    """Pre-tokens (as the model sees them) that the model encodes alone as one
    token.  At most as many as the vocabulary has entries."""
    from tokenizers import Tokenizer
    full = Tokenizer.from_str(tokenizer_text)
    model = full.model
    back = {c: b for b, c in wb.byte_characters().items()}
    suffix = model.end_of_word_suffix or ""
    proven = []
    for entry, number in full.get_vocab(with_added_tokens=False).items():
        if suffix and not entry.endswith(suffix):
            continue
        body = entry[:len(entry) - len(suffix)]
        if not body or any(c not in back for c in body):
            continue
        try:
            text = bytes(back[c] for c in body).decode()
        except UnicodeDecodeError:
            continue
        if not wb._DIRECT.fullmatch(text) or wb._PRETOKEN.findall(text) != [text]:
            continue
        got = model.tokenize(body)
        if len(got) == 1 and got[0].id == number:
            proven.append(text)
    return proven


class _Counter(wb.WordBPE):
    """Counts only: a known whole token is 1, another pre-token is merged."""

    def __init__(self, tokenizer_text: str, whole: list[str]):
        super().__init__(tokenizer_text)
        self.whole = frozenset(whole)
        self.shortcut = self.merged = 0

    def count(self, w: str) -> int:
        if w in self.whole:
            self.shortcut += 1
            return 1
        if not wb._DIRECT.fullmatch(w):
            return len(self.full.encode(w, add_special_tokens=False).ids)
        n = 0
        for p in wb._PRETOKEN.findall(w.lower()):
            if p in self.whole:
                n += 1
                self.shortcut += 1
            else:
                n += self._merged(p)
        return n

    def _merged(self, p: str) -> int:
        got = self.pre.get(p)
        if got is None:
            self.merged += 1
            got = self.pre[p] = len(self.model.tokenize(wb.byte_level(p)))
        return got

    def _keep(self, words: list[str]) -> None:
        self._reset()

    def _add(self, words: list[str]) -> None:
        n = len(self.slot)
        while n + len(words) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[n:n + len(words)] = np.fromiter(map(self.count, words), np.int32, len(words))
        self.slot.update(zip(words, range(n, n + len(words))))

    def totals(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        whole = self._whole(texts)
        if whole:
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        offsets, slot = self._split(texts)
        ends = np.concatenate([[0], np.cumsum(self.counts[slot], dtype=np.int64)])
        out = np.diff(ends[offsets])
        for i, ids in whole.items():
            out[i] = len(ids)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    One narrow scan, no shuffle.  The table of proven whole tokens and the
    vocabulary file are broadcast; both are bounded by the vocabulary."""
    text = wb.tokenizer_json(tokenizer_path)
    key = wb.key_of(text)
    shared = docs.sparkSession.sparkContext.broadcast((text, prove_whole_tokens(text)))

    def run(batches):
        counter = wb.held("count", key, lambda: _Counter(*shared.value))
        for batch in batches:
            texts = wb.text_array(batch.column(1))
            tokens = [counter.totals(texts.slice(a, n)) for a, n in wb.slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                 pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))
