"""Driver queries: deduplication family (K4)."""

from __future__ import annotations

from weft.operators import dedup
from weft.plans.registry import query
from weft.sources.tables import read_table


def _docs(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text", "lang", "n_chars"])


@query("exact_dedup", sql="""
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang,
       arg_min(n_chars, doc_id) AS n_chars, count(*) AS n_copies
FROM documents GROUP BY text
""")
def exact_dedup(spark, sf):
    """Documents, first row (by doc_id) of every distinct text survives."""
    return dedup.exact_dedup(_docs(spark, sf), "text", "doc_id", ["lang", "n_chars"])


@query("dedup_summary", sql="""
SELECT count(*) AS n_original, count(DISTINCT text) AS n_after,
       count(*) - count(DISTINCT text) AS n_removed
FROM documents
""")
def dedup_summary(spark, sf):
    """Original / after / removed."""
    kept = dedup.exact_dedup(_docs(spark, sf), "text", "doc_id")
    return dedup.dedup_summary(kept)


def _questions(spark, sf):
    """The dedup key is each drill's first turn ('' when it has none)."""
    from pyspark.sql import functions as F

    from weft.functions.text import first_turn
    from weft.plans import bindings
    return bindings.drills(spark, sf).select(
        "conv_id", "category", first_turn(F.col("turns")).alias("question"))


@query("fuzzy_dedup")
def fuzzy_dedup(spark, sf):
    """J7 + O3: drills whose question is identical or >= 95 similar (indel
    ratio) to an earlier drill's are removed; whole texts, no match cap.
    Checked against all-pairs brute force in tests/test_fuzzy.py."""
    kept, _ = dedup.fuzzy_dedup(_questions(spark, sf), "question", "conv_id", ["category"])
    return kept


# LCS of two short strings by bit vectors: v starts with a bit for every character
# of the second one, each character of the first clears one bit at most.
_URL_PAIRS = """
d AS (SELECT min(page_id) AS id, url AS s, length(url) AS n FROM pages GROUP BY url),
c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS len_a, b.n AS len_b, a.s AS sa, b.s AS sb, (1::HUGEINT << b.n::INT) - 1 AS full_
      FROM d a JOIN d b ON a.id < b.id AND 200 * least(a.n, b.n) >= 95 * (a.n + b.n)),
v AS (SELECT *, list_reduce(list_prepend(full_, list_transform(range(1, len_a + 1), lambda i: list_sum(list_transform(
                  range(1, len_b + 1), lambda j: CASE WHEN sb[j] = sa[i] THEN 1::HUGEINT << (j - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)),
                lambda v, m: ((v + (v & m)) | (v - (v & m))) & full_) AS bits FROM c),
p AS (SELECT id_a, id_b, len_a, len_b, len_b - bit_count(bits)::BIGINT AS lcs FROM v
      WHERE 200 * (len_b - bit_count(bits)::BIGINT) >= 95 * (len_a + len_b))"""


def _pages(spark, sf):
    return read_table(spark, sf, "pages", ["page_id", "url"])


@query("fuzzy_pairs", sql=f"""
WITH {_URL_PAIRS}
SELECT id_a, id_b, len_a, len_b, lcs FROM p
""")
def fuzzy_pairs(spark, sf):
    """Verified pairs of similar page addresses (first page ids, lengths, LCS)."""
    _, pairs = dedup.fuzzy_dedup(_pages(spark, sf), "url", "page_id")
    return pairs


@query("fuzzy_dedup_pages", sql=f"""
WITH {_URL_PAIRS}
SELECT id AS page_id, (SELECT count(*) FROM pages q WHERE q.url = d.s) AS n_copies
FROM d WHERE id NOT IN (SELECT id_b FROM p)
""")
def fuzzy_dedup_pages(spark, sf):
    """J7 + O3: pages whose address no earlier page has, or has but for 5 %."""
    kept, _ = dedup.fuzzy_dedup(_pages(spark, sf), "url", "page_id")
    return kept.select("page_id", "n_copies")


@query("fuzzy_dedup_documents")
def fuzzy_dedup_documents(spark, sf):
    """J7 + O3 on whole documents (exact, lossless blocking); checked against
    all-pairs brute force on sf0.001 in tests/test_fuzzy.py."""
    kept, _ = dedup.fuzzy_dedup(_docs(spark, sf), "text", "doc_id", ["lang"])
    return kept.select("doc_id", "lang", "n_copies")


@query("knn_dups", sql="""
WITH p AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
                  list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
           WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.85),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbor_id) AS rank FROM p)
SELECT vec_id, neighbor_id, round(c, 6) AS cosine, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 8
""")
def knn_dups(spark, sf):
    """Up to 8 neighbours with cosine >= 0.85 per embedding (exact,
    block by block; checked in tests/test_vectors.py)."""
    from weft.operators import vectors
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return vectors.knn(e, "vec_id", "embedding", dim=64)
