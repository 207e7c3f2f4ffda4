"""Embedding near neighbours (cosine >= t, best k per vector), exactly.

Equal vectors form a class; one vector of each is compared.  The classes are cut
into blocks, and every two blocks meet in one task: a matrix product in single
precision, with a margin for its rounding, finds the pairs near the threshold, and
their cosine is taken in double precision.  A task gives at most ``k`` classes a
class, so pairs below the threshold or behind the best ``k`` never leave it: the
shuffle holds each class once a block, and the number of blocks is fixed until a
block would exceed ``BLOCK_ROWS``.  The comparisons are quadratic (about a
nanosecond each), as any exact search among vectors without structure.

Members of a class come back by a join: of each class at most the first ``k`` + 1
ids are listed, which is all that the best ``k`` of any member can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import scratch_path
from weft.sources.tables import dealt

#: Blocks of classes where there are enough, most rows of a block, and the rows of
#: both sides that one matrix product takes.
BLOCKS, BLOCK_ROWS, TILE = 12, 1 << 17, (1024, 8192)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def normalize(v: Column) -> Column:
    n = _norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _dots(v: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """``dot`` of the rows ``x`` and ``y`` of ``v``, summed in the same order."""
    out = np.zeros(len(x))
    for k in range(0, len(x), rows):
        out[k:k + rows] = np.cumsum(v[x[k:k + rows]] * v[y[k:k + rows]], axis=1)[:, -1]
    return out


def _best(owner: np.ndarray, other: np.ndarray, cosine: np.ndarray, place: np.ndarray, k: int):
    """The ``k`` rows of each owner with the largest cosine, ties to the least place."""
    order = np.lexsort((place[other], -cosine, owner))
    owner, other, cosine = owner[order], other[order], cosine[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return owner[nth < k], other[nth < k], cosine[nth < k]


def near_in_blocks(v: np.ndarray, block: np.ndarray, place: np.ndarray, threshold: float, k: int, rows: int = 1 << 20):
    """(owner, other, cosine), as row numbers: of each row of one of the two blocks
    in ``block`` the best ``k`` rows of the other one (of its own, if there is one)
    with a cosine of ``threshold`` or more.  About ``rows`` rows are held besides them."""
    low, high = block.min(), block.max()
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    single, least = v.astype(np.float32), threshold - v.shape[1] * 2.0 ** -22
    held, size = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0
    more = [held]
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            x, y = np.nonzero(single[a[i:i + TILE[0]]] @ single[b[j:j + TILE[1]]].T >= least)
            x, y = a[i:i + TILE[0]][x], b[j:j + TILE[1]][y]
            cosine = _dots(v, x, y)
            near = (cosine >= threshold) & (x != y)
            more.append((x[near], y[near], cosine[near]))
            if low != high:
                more.append((y[near], x[near], cosine[near]))
            size += int(near.sum())
            if size > rows:
                more, size = [_best(*map(np.concatenate, zip(*more)), place, k)], 0
    return _best(*map(np.concatenate, zip(*more)), place, k)


def near_classes(classes: DataFrame, dim: int, threshold: float, k: int) -> DataFrame:
    """(_c, _d, _first, cosine): of each class of ``classes`` (_c, _id, _v) the best
    ``k`` others with a cosine of ``threshold`` or more, ties to the smaller id."""
    kind = classes.schema["_id"].dataType.simpleString()
    n = classes.count()
    blocks = max(1, min(BLOCKS, n // TILE[0]), -(-n // BLOCK_ROWS))
    met = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt_out = (classes.withColumn("_block", F.pmod(F.xxhash64("_c"), F.lit(blocks)).cast("int")).withColumn("_other", met)
                        .withColumn("_pair", F.least("_block", "_other") * blocks + F.greatest("_block", "_other")).drop("_other"))

    def run(table: pa.Table) -> pa.Table:
        v = np.asarray(table.column("_v").combine_chunks().flatten()).reshape(-1, dim)
        place = np.empty(len(v), np.int64)
        place[np.asarray(pc.sort_indices(table.column("_id")))] = np.arange(len(v))
        pair, block = table.column("_pair")[0].as_py(), np.asarray(table.column("_block"))
        whole = len(v) and (pair // blocks == pair % blocks or block.min() != block.max())
        owner, other, cosine = near_in_blocks(v, block, place, threshold, k) if whole else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        c = table.column("_c").combine_chunks()
        return pa.table({"_c": c.take(pa.array(owner)), "_d": c.take(pa.array(other)),
                         "_first": table.column("_id").combine_chunks().take(pa.array(other)), "cosine": pa.array(cosine)})

    near = dealt(dealt_out, "_pair").groupBy("_pair").applyInArrow(run, f"_c binary, _d binary, _first {kind}, cosine double")
    w = Window.partitionBy("_c").orderBy(F.col("cosine").desc(), "_first")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def knn(df: DataFrame, id_col: str, vec_col: str, dim: int, threshold: float = 0.85, k: int = 8) -> DataFrame:
    """(id, neighbor_id, cosine, rank) for neighbours with cosine >= threshold: the
    best ``k`` of each vector, ties to the smaller id."""
    # Null and zero vectors, vectors of another length or that are not finite have no cosine.
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = df.filter((F.size(vec_col) == dim) & F.exists(vec_col, lambda x: x != 0) & F.forall(vec_col, finite))
    base = (dealt(able.select(F.col(id_col).alias("_id"), normalize(F.col(vec_col)).alias("_v")), "_id")
            .withColumn("_c", F.unhex(F.sha2(F.col("_v").cast("string"), 256))))
    path = scratch_path(df.sparkSession, "knn")
    w = Window.partitionBy("_c").orderBy("_id")
    base.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).write.parquet(path)
    firsts = df.sparkSession.read.parquet(path)
    near = near_classes(firsts.where("_n = 1").select("_c", "_id", "_v"), dim, threshold, k)
    others = near.join(firsts.select(F.col("_c").alias("_d"), "_id"), "_d").select("_c", "_id", "cosine")
    own = firsts.select("_c", "_id", dot(F.col("_v"), F.col("_v")).alias("cosine")).where(F.col("cosine") >= threshold)
    best = Window.partitionBy("_c").orderBy(F.col("cosine").desc(), "_id")
    lists = (others.unionByName(own).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
                   .groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_n", "_id", "cosine"))).alias("_best")))
    mine = F.slice(F.filter("_best", lambda x: x["_id"] != F.col("_me")), 1, k)
    return (base.select(F.col("_id").alias("_me"), "_c").join(lists, "_c")
                .select("_me", F.posexplode(mine).alias("_rank", "_x"))
                .select(F.col("_me").alias(id_col), F.col("_x._id").alias("neighbor_id"),
                        F.round("_x.cosine", 6).alias("cosine"), (F.col("_rank") + 1).cast("bigint").alias("rank")))
