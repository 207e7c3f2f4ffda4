"""The SentencePiece codec against the library: ids, spans, decoding, and its
normaliser against the library's on a real compiled map."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

import public_tokenizers as P
from weft.llm import sp_codec

PATH = P.path("piece_bpe_32k.model")
MODEL = sp_codec.model_bytes(PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n\n x\n", "Hello world, it's 12 o'clock", "ciónar ñ é ß", "日本語テキスト", "😀 😀x", "▁a ▁", "a▁b",
       "x\x00y", "\t tab", "<s> </s> <unk> <0x0A>", "é", "ﬁ ① ｱ", "a" * 3000, "　full　width", "\r\nline", " "]


def texts(n=200, seed=3):
    rng = random.Random(seed)
    parts = ["the", " ", " ", "  ", "\n", "é", "中", "▁", "😀", "ing", "12", ".", "\t", "ñ", "A", "ﬁ", "①", "　"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def check(model, data):
    codec, lib = sp_codec.Codec(model, max_words=50), sentencepiece.SentencePieceProcessor(model_proto=model)
    for at in range(0, len(data), 41):
        part = data[at:at + 41]
        offsets, ids, begins, ends = codec.encode(pa.array([*part, None]))
        decoded = codec.decode(offsets, ids)
        for i, t in enumerate(part):
            mine = ids[offsets[i]:offsets[i + 1]].tolist()
            assert mine == lib.encode(t), repr(t)
            assert decoded[i] == lib.decode(mine)
            spans = list(zip(begins[offsets[i]:offsets[i + 1]].tolist(), ends[offsets[i]:offsets[i + 1]].tolist()))
            raw, merged, theirs = t.encode(), [], []
            for piece, span, other in zip(mine, spans, ((p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces)):
                if lib.is_byte(piece):                  # the library puts a character's span on its last byte
                    continue
                merged.append(span)
                theirs.append(other)
            assert merged == theirs, (t, merged, theirs)
            assert all(a <= b <= len(raw) for a, b in spans)


def test_identity_model():
    check(MODEL, texts())


def mapped_model(rule, squeeze):
    proto = pb.ModelProto.FromString(MODEL)
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec.FromString(n.serialized_normalizer_spec())
    proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    return proto.SerializeToString()


@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_map_model(squeeze):
    try:
        model = mapped_model("nmt_nfkc", squeeze)
    except (RuntimeError, OSError, TypeError) as e:
        pytest.skip(f"no compiled map here: {e}")
    codec = sp_codec.Codec(model)
    assert codec.map.units is not None
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in texts():
        got, _ = codec.normalise(t)
        assert got.decode() == lib.normalize(t), repr(t)
    check(model, texts())


def test_operator(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "x") for i, t in enumerate(texts(40))] + [(3, "again", "x"), (None, "a b", None), (99, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sp_codec.encode(docs, PATH).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(
        ((i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t, _ in rows), key=repr)
    assert sp_codec.encode(docs.limit(0), PATH).count() == 0


def test_query(spark):
    from weft.llm.queries import QUERIES
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sf = "/root/testdata/sf0.001"
    docs = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = QUERIES["op6_sentencepiece"](spark, sf).collect()
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = lib.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spans_bytes) == (
            len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), len((docs[r.doc_id] or "").encode()))
