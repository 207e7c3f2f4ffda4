"""Round trips of the token file format; queries against the library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers as P
from tests.llm.test_tokens import texts
from weft.llm.token_files import decode_block, encode_block, read_token_files, write_token_files

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 70_000)), max_size=400))
def test_block_round_trip(ids):
    a = np.array(ids, np.uint32)
    ranked, control, data = encode_block(a)
    assert len(control) == -(-len(ids) // 4) and decode_block(len(ids), ranked, control, data).tolist() == ids


def test_block_with_every_length():
    ids = np.concatenate([np.arange(70_000, dtype=np.uint32), np.repeat(np.uint32(69_999), 50)])
    ranked, control, data = encode_block(ids)
    assert np.frombuffer(ranked, "<u4")[0] == 69_999          # the most frequent id has rank 0
    assert len(data) == 50 + 256 + 2 * (65_536 - 256) + 3 * (70_000 - 65_536)
    assert (decode_block(len(ids), ranked, control, data) == ids).all()


def test_write_and_read(spark, tmp_path):
    full = Tokenizer.from_file(PATH)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts(80))] + [(5, "again", None), (5, "again", None), (None, "the", "y"), (10**12, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    write_token_files(docs, PATH, str(tmp_path / "t"), end_id=1)
    got = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at, order = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t, _) in zip(got, order):
        want = full.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.asarray(want, "<u4").tobytes())
        at += len(want)
    write_token_files(docs.limit(0), PATH, str(tmp_path / "e"))
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("name", ["op1_token_files", "op3_packing", "op4_token_counts"])
def test_query_against_library(spark, name):
    from weft.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    full = Tokenizer.from_file(PATH)
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = QUERIES[name](spark, sf).collect()
    ids = {i: full.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    if name.startswith("op1"):
        at = 0
        for r, (i, _) in zip(sorted(got, key=lambda r: r.doc_id), docs, strict=True):
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids[i]) + 1, crc(ids[i] + [1]))
            at += r.n_tokens
    elif name.startswith("op3"):
        seen = {}
        for r in got:
            assert r.ids_crc32 == crc((ids[r.doc_id] + [2])[r.start:r.start + r.length]) and r.length & r.length - 1 == 0
            seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        assert seen == {i: len(x) + 1 for i, x in ids.items()} and len({r.sequence_id for r in got}) == len(got)
    else:
        assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in got} == {
            i: (len(ids[i]), len((t or "").encode()), len(ids[i]) > 2048) for i, t in docs}
