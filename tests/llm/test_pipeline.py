"""The corpus pipeline, stage by stage, with planted documents."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
import public_tokenizers
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) + ("." if k % 11 == 10 else "") for k in range(n))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """All stages over sf0.01 with planted rows; {stage: DataFrame}."""
    path = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(6)
    passage, base = prose(rng, 70), prose(rng, 300)
    planted = [(10**6, base), (10**6 + 1, base.replace(".", "", 1)), (10**6 + 2, prose(rng, 90) + "\n" + passage + "\n" + prose(rng, 60)),
               (10**6 + 3, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 90)), (10**6 + 4, "write to jo.doe@mail.example.com or 10.20.30.40 " + prose(rng, 50)),
               (10**6 + 5, None), (10**6 + 6, ""), (None, prose(rng, 40))]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", None, None) for i, t in planted], docs.schema)
    out = {"documents": docs.unionByName(extra)}
    out["documents"].write.parquet(f"{path}/documents")
    now = out["documents"] = spark.read.parquet(f"{path}/documents")
    for name, stage in P.STAGES:
        stage(spark, now, SF).write.parquet(f"{path}/{name}")
        now = out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_rows(run):
    for name in ("toxicity", "line_dedup", "jaccard_join", "pii"):
        assert run[name].columns == run["documents"].columns
    assert run["line_dedup"].count() == run["toxicity"].count() and run["pii"].count() == run["jaccard_join"].count()
    assert all(texts(run["toxicity"])[i] == t for i, t in texts(run["documents"]).items() if (i or 0) >= 10**6)


def test_toxic_documents_go(run, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    kept = texts(run["toxicity"])
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(toxic & kept.keys()) < 0.4 * len(toxic) and len(clean - kept.keys()) <= 0.02 * len(clean)


def test_passage_goes_once(run):
    before, after = texts(run["toxicity"]), texts(run["line_dedup"])
    assert after[10**6 + 2] == before[10**6 + 2] and len(after[10**6 + 3]) < len(before[10**6 + 3]) - 250
    lengths = run["line_dedup"].filter(~F.col("n_chars").eqNullSafe(F.length("text").cast("long"))).count()
    assert lengths == 0


def test_one_of_each_group_stays(run):
    before = [(i, t) for i, t in texts(run["line_dedup"]).items() if i is not None]
    stay = {i for i, _, c in brute(before) if i == c}
    assert {i for i in texts(run["jaccard_join"]) if i is not None} == stay
    assert None in texts(run["jaccard_join"])


def test_pii_is_replaced(run):
    after = texts(run["pii"])
    assert after[10**6 + 4].startswith("write to [EMAIL] or [IP] ")
    assert not [t for t in after.values() if t and "@mail" in t]


def test_pieces_are_the_documents(run):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = texts(run["pii"])
    got = {}
    for r in run["packing"].collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert got.keys() == want.keys()
    for i, t in want.items():
        assert [x for _, ids in sorted(got[i]) for x in ids] == full.encode(t or "", add_special_tokens=False).ids + [2]


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, "/root/testdata/sf0.001").columns[:3] == ["doc_id", "start", "length"]


def test_extra_columns_with_any_name(spark, tmp_path):
    """Names that the operators use themselves come out with their values."""
    names = ["score", "predicted", "spans", "_t", "_id", "_th", "_cuts", "others", "row", "y", "id", "t", "component_id", "none"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", "text", "n_chars")
    now = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == before.columns and now.count() > 60
        assert now.where(" OR ".join(f"NOT `{n}` <=> concat('{n}', doc_id)" for n in names)).count() == 0
    assert P.STAGES[-1][1](spark, now, SF).count() > 60
