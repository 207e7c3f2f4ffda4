"""Word-cached encoding, token counts and packing against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from weft.llm import wordbpe as wb
from weft.llm.packing import decompose, pack
from weft.llm.token_counts import count_tokens, prove_whole_tokens

PATH = P.path("word_bpe_49k.json")
ODD = ["", " ", "Hello, World's 12.5% don't", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", " a b\u0085c",
       "été Å Å İstanbul Σσς ẞ", "\x00a\x1fb\x7f", "日本語 テキスト", "½²x¹ª", "à̧ b",
       "​zero﻿", "😀😀 don't'S 'LL we'Re", "µ ſ ĸ ŉ", "a" * 5000, "1234567890" * 50, "don’t", "\t\n a\r\nb\x0b\x0c c", "<| x", "naïve Ĳ ĳ ﬁ Ǆ"]


def texts(n=300, seed=5):
    rng = random.Random(seed)
    parts = ["the", "The", "and", " ", "  ", "\n", "'s", "'LL", ".", ",", "é", "É", "ß", "ñ", "12", "½", "́", "Σ", "İ", " ", " ", "<|", "|>", "中", "😀", "anblewh", "ciónar", "\x00", "-", "_", "ʼn", "µ", "ŉ"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_encoder_equals_library():
    full = Tokenizer.from_file(PATH)
    enc = wb.WordBPE(wb.tokenizer_json(PATH), max_words=200)   # small: the cache is emptied on the way
    data = texts()
    for at in range(0, len(data), 37):
        part = data[at:at + 37]
        got = enc.encode(pa.array([*part, None]))
        for i, t in enumerate(part):
            assert got.ids[got.offsets[i]:got.offsets[i + 1]].tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)
        assert got.offsets[-1] == got.offsets[-2]


def test_cache_is_bounded_and_keeps_common_words(monkeypatch):
    """When the cache is full, words of the batch at hand are not encoded again, and no word is kept twice."""
    enc = wb.WordBPE(wb.tokenizer_json(PATH), max_words=200)
    full, seen = Tokenizer.from_file(PATH), []
    word = enc.word
    monkeypatch.setattr(enc, "word", lambda w: seen.append(w) or word(w))
    for k in range(40):
        text = "the common words " + " ".join(f"rare{''.join(chr(97 + int(c)) for c in str(k * 50 + n))}" for n in range(50)) + " the, end."
        got = enc.encode(pa.array([text]))
        assert got.ids.tolist() == full.encode(text, add_special_tokens=False).ids
        assert len(enc.slot) <= 200 and not any(len(p) > 4 for p in enc.pre)
    assert all(seen.count(w) == 1 for w in ("the", "common", "words", "the,", "end."))


def test_every_proven_whole_token_is_one_token():
    full = Tokenizer.from_file(PATH)
    whole = prove_whole_tokens(wb.tokenizer_json(PATH))
    assert len(whole) > 20_000
    sample = random.Random(1).sample(whole, 3000)
    assert all(len(e.ids) == 1 for e in full.encode_batch(sample, add_special_tokens=False))


def test_slices_cover_all():
    a = pa.array(["x" * 10, None, "", "y" * 100, "z"])
    for limit in (1, 15, 50, 10_000):
        got = wb.slices(a, limit)
        assert [i for s, n in got for i in range(s, s + n)] == list(range(5))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(60))] + [(7, "again", "x"), (7, "again", "x"), (None, "the", None), (900, None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_count_tokens(spark, odd_docs):
    full = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, count_tokens(odd_docs, PATH, limit=20).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        n = len(full.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 20))
    assert got == sorted(want, key=repr)
    assert count_tokens(odd_docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n,want", [(1, [1]), (4096, [4096]), (4097, [4096, 1]), (7, [4, 2, 1]), (9000, [4096, 4096, 512, 256, 32, 8])])
def test_decompose(n, want):
    assert decompose(n, 4096) == want and sum(want) == n


def test_pack_round_trip(spark, odd_docs):
    full = Tokenizer.from_file(PATH)
    rows = pack(odd_docs, PATH, max_len=64, end_id=2).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    docs = {}
    for r in rows:
        assert r.length == len(r.ids) == 1 << r.bucket <= 64 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        docs.setdefault(r.doc_id, []).append(r)
    for r in odd_docs.collect():
        want = full.encode(r.text or "", add_special_tokens=False).ids + [2]
        mine = sorted(docs[r.doc_id], key=lambda x: (x.start, x.sequence_id))
        if r.doc_id == 7:
            continue
        assert [i for x in mine for i in x.ids] == want and {x.doc_tokens for x in mine} == {len(want)}
        assert [x.start for x in mine] == list(np.cumsum([0] + [x.length for x in mine])[:-1])
    assert pack(odd_docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(odd_docs, PATH, max_len=100)


def test_pack_with_a_small_cache_gives_the_same_rows(odd_docs):
    plain, small = (sorted(map(repr, pack(odd_docs, PATH, **a).drop("sequence_id", "offset").collect()))
                    for a in ({}, {"cache_words": 20, "slice_bytes": 200}))
    assert plain == small
