"""Words of a run of texts: maximal runs of bytes other than the ASCII white
space 0x20 and 0x09 to 0x0D (inside tasks, in numpy and Arrow)."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclasses.dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as places in
    ``distinct``; ``words`` has them as strings, ``raw`` the texts' bytes and
    ``ends`` the texts' bounds in it."""
    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array
    words: pa.Array
    raw: np.ndarray
    ends: np.ndarray


def split(texts: pa.Array) -> Words:
    """A null text has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    solid = ~_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = solid[begins]                       # a word never goes on into the next text
    starts = np.flatnonzero(first)
    at = np.append(np.cumsum(solid, dtype=np.int32)[starts] - 1, solid.sum())
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw[solid]))
    coded = words.dictionary_encode()
    return Words(np.searchsorted(starts, ends), np.asarray(coded.indices), coded.dictionary, words, raw, ends)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes (no word is empty)."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    begins = ends[:-1] - ends[0]
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(begins, np.diff(ends)).astype(np.uint64)
    each = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ place * np.uint64(0xC2B2AE3D27D4EB4F)
    each = (each ^ each >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    found = np.add.reduceat(each ^ each >> np.uint64(29), begins)
    return (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(8)
