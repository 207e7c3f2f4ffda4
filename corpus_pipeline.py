"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; stages are written as Parquet and read again.
Extra columns of ``documents`` go through every stage but the last, which
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import pii
from weft.llm.jaccard_join import jaccard_components
from weft.llm.line_dedup import line_dedup
from weft.llm.packing import pack
from weft.llm.queries import WORD_BPE, table, tokenizer_path
from weft.llm.toxicity import score, train
from weft.session import scratch_path


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, is that of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _beside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one: no name that an operator uses
    meets one of theirs."""
    others = [docs[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("others"))


def _again(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of ``_beside``."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _again(score(_beside(docs), model).filter("predicted = 0"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return _with_length(_again(line_dedup(_beside(docs), min_words=25), docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id.
    Rows that repeat an id stay together; rows with a null id stay."""
    groups = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    gone = groups.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    found = pii.find(_beside(docs), pii.train(docs))
    return _with_length(_again(pii.redact(found), docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 4096, each of one document."""
    # The executor's heap is full from the stages before, so its Python workers hold little.
    return pack(docs.select("doc_id", "text"), tokenizer_path(WORD_BPE), max_len=4096, end_id=2,
                cache_words=100_000, slice_bytes=1 << 20)


STAGES = [("toxicity", toxicity), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents),
          ("pii", redact_pii), ("packing", packing)]

#: Passages of neighbouring lines, a trained classifier and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    path = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        out = f"{path}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
