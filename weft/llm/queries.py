"""The ``opN_<name>`` queries: thin calls of the operators with production
parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary files, by the name that the tokenizer package knows.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.packing import pack
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, tokenizer_path(WORD_BPE), max_len=4096, end_id=2, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.token_counts import count_tokens
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, tokenizer_path(WORD_BPE), limit=2048)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.token_files import read_token_files, write_token_files
    from weft.session import scratch_path
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, tokenizer_path(WORD_BPE), path, end_id=1)
    return read_token_files(spark, path, with_ids=False)


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.sp_codec import digest
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digest(docs, tokenizer_path(PIECE_BPE))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.fingerprints import fingerprint
    return fingerprint(table(spark, sf_dir, "documents", "doc_id", "text"), samples=64)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.line_dedup import line_dedup
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup(docs, min_words=25, removed_col="removed_lines")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.toxicity import held_out, score, train
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import pii
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=5, percent=80)


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0, top=20)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import periodic_runs as R
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return R.digest(R.periodic_runs(R.with_repeats(docs), min_words=12))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.filter_audit import audit
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                 table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), min_words=100, distinct_percent=80,
                 upper_percent=10, signs="#$%&*|")


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, MIN(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (
  SELECT part,
         len(ws) < 100 AS a,
         100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         COALESCE(w.doc_id > low, false) AS e,
         COALESCE(q = 1, false) AS good, COALESCE(x = 1, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, MAX(quality) AS q, MAX(toxic) AS x FROM labels GROUP BY doc_id) l USING (doc_id)),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
         COUNT(*) AS n, SUM(good::INT) AS good, SUM(toxic::INT) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE l2.x NOT IN (l1.x) AND l3.x NOT IN (l1.x, l2.x) AND l4.x NOT IN (l1.x, l2.x, l3.x)
    AND l5.x NOT IN (l1.x, l2.x, l3.x, l4.x)),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         COALESCE(list_sum([1 << (ascii(filter_order[k]) - 65) FOR k IN range(1, step)]), 0)::INT AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own,
         CAST(SUM(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(SUM(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(SUM(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(SUM(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(SUM(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(SUM(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.subword import learns, score, train
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), modulus=3, held=1)
    return score(docs, model).select("doc_id", (~learns("doc_id", 3, 1)).alias("held_out"), "score", "predicted")
