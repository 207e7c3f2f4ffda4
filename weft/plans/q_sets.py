"""Driver queries: set operations, splits, ordering, resume (U1, U2, O2, O4,
O5, O6, F11, J1, W5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators.ordering import row_number_within
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS
from weft.sources.tables import read_table

SPLIT_SEED = 42
FIRST_N = 20
POS_MOD, POS_TRAIN = 1112, 1056
FULL_BATCH = 4
RESUME_SKIP = 100


def split_bucket(seed: int, id_col) -> F.Column:
    """Deterministic 0..99 bucket from md5(seed:id); stable under any
    repartitioning (a shuffle-based split is not)."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8)
    return F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(100))


@query("split", sql=f"""
SELECT conv_id, CASE WHEN ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 50
                THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def split(spark, sf):
    """Seeded 50/50 train/test split of conversations."""
    c = read_table(spark, sf, "conversations", ["conv_id"]).distinct()
    return c.select("conv_id", F.when(split_bucket(SPLIT_SEED, "conv_id") < 50, "train")
                    .otherwise("test").alias("split"))


@query("union_mix", sql=f"""
WITH {DRILLS}
SELECT 'mtbench' AS source, CAST(sum(len(turns)) AS BIGINT) AS n_examples FROM drills
WHERE len(reference) > 0 AND len(turns) = len(reference)
UNION ALL SELECT 'exam', count(*) FROM part
""")
def union_mix(spark, sf):
    """Multi-turn examples and exam examples concatenated (unionByName)."""
    d = bindings.drills(spark, sf).where((F.size("reference") > 0)
                                         & (F.size("turns") == F.size("reference")))
    mt = d.select(F.lit("mtbench").alias("source"), F.explode("turns").alias("_x"))
    ex = bindings.exam(spark, sf).select(F.lit("exam").alias("source"), F.col("question").alias("_x"))
    return mt.unionByName(ex).groupBy("source").agg(F.count(F.lit(1)).alias("n_examples"))


@query("leave_one_out", sql="""
WITH s AS (SELECT split_part(p_type, ' ', 1) AS subset, count(*) AS n FROM part GROUP BY 1)
SELECT subset, n AS n_train, CAST(sum(n) OVER () - n AS BIGINT) AS n_eval FROM s
""")
def leave_one_out(spark, sf):
    """Train on one subset, evaluate on the union of the others."""
    e = bindings.exam(spark, sf)
    s = e.groupBy("subset").agg(F.count(F.lit(1)).alias("n_train"))
    # window over the per-subset aggregate (one row per subset)
    return s.withColumn("n_eval", (F.sum("n_train").over(Window.partitionBy(F.lit(0)))
                                   - F.col("n_train")).cast("bigint"))


@query("first_n", sql=f"SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT {FIRST_N}")
def first_n(spark, sf):
    """O2: first n rows in an explicit order (distributed top-k)."""
    d = read_table(spark, sf, "documents", ["doc_id", "lang"])
    return d.orderBy("doc_id").limit(FIRST_N)


@query("positional_split", sql=f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos,
       (row_number() OVER (ORDER BY doc_id) - 1) % {POS_MOD} < {POS_TRAIN} AS is_train
FROM documents
""")
def positional_split(spark, sf):
    """``(i mod 1112) < 1056`` by position, on range-partitioned numbering."""
    d = read_table(spark, sf, "documents", ["doc_id"])
    n = row_number_within(d, [], ["doc_id"], out="rn")
    return n.select("doc_id", (F.col("rn") - 1).alias("pos"),
                    (F.pmod(F.col("rn") - 1, F.lit(POS_MOD)) < POS_TRAIN).alias("is_train"))


@query("full_batches", sql=f"""
WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn,
                  count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS n_rows, count_if((rn - 1) // {FULL_BATCH} < n // {FULL_BATCH}) AS n_scored,
       count_if((rn - 1) // {FULL_BATCH} >= n // {FULL_BATCH}) AS n_dropped
FROM r GROUP BY lang
""")
def full_batches(spark, sf):
    """parity option that keeps only full batches of four per subset
    (the source drops the ``n mod 4`` tail); default scoring keeps all."""
    d = read_table(spark, sf, "documents", ["doc_id", "lang"])
    n = row_number_within(d, ["lang"], ["doc_id"], out="rn")
    sizes = d.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(sizes, "lang")
    full = F.floor((F.col("rn") - 1) / FULL_BATCH) < F.floor(F.col("_n") / FULL_BATCH)
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_if(full).alias("n_scored"),
                                 F.count_if(~full).alias("n_dropped"))


@query("resume_by_id", sql="""
SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
""")
def resume_by_id(spark, sf):
    """Entries not yet done (left anti join on the id)."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    done = (read_table(spark, sf, "lineitem", ["l_orderkey", "l_linestatus"])
            .where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey")))
    return o.join(done, "o_orderkey", "left_anti")


@query("resume_by_pos", sql=f"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn
                          FROM conversations) WHERE rn > {RESUME_SKIP}
""")
def resume_by_pos(spark, sf):
    """Positional resume, skip the first n rows (parity mode; resume by
    id is the default)."""
    c = read_table(spark, sf, "conversations", ["conv_id", "turn"])
    n = row_number_within(c, [], ["conv_id", "turn"], out="rn")
    return n.where(F.col("rn") > RESUME_SKIP).select("conv_id", "turn")
