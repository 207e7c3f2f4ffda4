"""Connected components of an edge table: alternating large-star and small-star
steps, each a map-side combined minimum and a join.  Nothing reaches the driver
but a count and a checksum per round; each round's edges are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import scratch_path


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _lowest(arcs: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours in directed arcs (u, v)."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node is tied to the least of its neighbourhood."""
    arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return arcs.filter("v > u").join(_lowest(arcs), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are tied to the least of them."""
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(arcs)
    return (arcs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; ``component`` is
    the least node that it reaches.  ``edges``: columns u and v of a long."""
    now = _written(edges.select("u", "v").filter("u != v").distinct())
    state = None
    for _ in range(max_rounds):
        now = _written(_small_star(_large_star(now)))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
        if state == (row.n, row.h):
            break
        state = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
