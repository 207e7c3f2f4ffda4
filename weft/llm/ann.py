"""Approximate nearest neighbours over balanced posting lists.

Fit (on a bounded sample): vectors are split in two, again and again, each time
into equal halves along the line between two means, and a few rounds of means
over all parts follow; the centroids are linked into a small graph (each to its
nearest, and back).  The centroids and their graph stay in memory.

Index (every row): a vector goes to the list of its nearest centroid, found by
the graph, and, when it lies near a boundary, to those of further centroids
within ``index_ratio`` of that distance.  Lists with many vectors are dealt out in parts, all of which are
searched, so no part is large, however full a list is.

Search: a query walks the graph as long as it finds centroids within
``query_ratio`` of the nearest one's distance, and all their lists are searched.
Scores are inner products in double precision.

Largest inner product is turned into least distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries, scaled to M).

Of vectors with equal components only the ``top`` + 1 smallest ids can be
results (ties go to the smaller id), so the others need not be indexed: a hot
vector makes no long list, and nothing is lost.

Results: null ids, and vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do vectors of another length than the
most frequent; rows of one id and vector count once, an id with several vectors
has the score of its best pair and is no result of its own; with fewer than ``top`` others a query
gets all; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import scratch_path


# -- the centroids and their graph ---------------------------------------------
def _halves(x: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """True for one half of the rows: equal halves along the line between two means."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    side = np.zeros(len(x), bool)
    for _ in range(rounds):
        order = np.argsort(x @ (b - a), kind="stable")
        side = np.zeros(len(x), bool)
        side[order[len(x) // 2:]] = True
        a, b = x[~side].mean(0), x[side].mean(0)
    return side


def balanced_centroids(x: np.ndarray, k: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """About k centroids of about equally large parts."""
    rng = np.random.default_rng(seed)
    parts, least = [np.arange(len(x))], max(2, len(x) // max(1, k))
    while len(parts) < k:
        parts.sort(key=len)
        big = parts.pop()
        if len(big) < 2 * least and len(big) < 4:
            parts.append(big)
            break
        side = _halves(x[big], rng)
        parts += [big[~side], big[side]]
    c = np.array([x[p].mean(0) for p in parts])
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def neighbour_graph(c: np.ndarray, degree: int = 12) -> np.ndarray:
    """Row per centroid: its nearest others, then those that have it as one of
    theirs, and its successor, which keeps the graph connected."""
    k = len(c)
    degree = min(degree, k - 1)
    if degree < 1:
        return np.zeros((k, 1), np.int32)
    lists: list[list[int]] = [[] for _ in range(k)]
    norm = (c * c).sum(1)
    for a in range(0, k, 512):
        d = norm - 2 * c[a:a + 512] @ c.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        for i, row in enumerate(near):
            lists[a + i] += [int(j) for j in row]
    back: list[list[int]] = [[] for _ in range(k)]
    for i, row in enumerate(lists):
        for j in row:
            if len(back[j]) < degree:
                back[j].append(i)
    width = 2 * degree + 1
    out = np.empty((k, width), np.int32)
    for i in range(k):
        row = list(dict.fromkeys([*lists[i], (i + 1) % k, *back[i]]))[:width]
        out[i] = row + [row[0]] * (width - len(row))
    return out


@dataclasses.dataclass
class Centroids:
    c: np.ndarray              # k x (d + 1), float64
    graph: np.ndarray
    starts: np.ndarray         # places where a walk begins
    largest: float             # M

    def walk(self, x: np.ndarray, ratio: float, width: int = 4, patience: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(distances, whether within ``ratio`` of the least) of rows of x to the
        centroids that a walk over the graph meets (inf: not met).

        A walk goes on from its best unvisited places while they are within the
        ratio or among the ``patience`` best so far: no number bounds it."""
        n, k = len(x), len(self.c)
        norm, xn = (self.c * self.c).sum(1), (x * x).sum(1)[:, None]
        d = np.full((n, k), np.inf)
        at = np.broadcast_to(self.starts, (n, len(self.starts)))
        todo = np.arange(n)
        gone = np.zeros((n, k), bool)
        while True:
            dist = norm[at] - 2 * np.einsum("nd,nmd->nm", x[todo], self.c[at], optimize=True) + xn[todo]
            d[todo[:, None], at] = np.sqrt(np.maximum(dist, 0))
            open_ = np.where(gone[todo], np.inf, d[todo])
            w = min(width, k)
            best = np.argpartition(open_, w - 1, axis=1)[:, :w] if w < k else np.broadcast_to(np.arange(k), open_.shape)
            value = np.take_along_axis(open_, best, 1)
            seen = d[todo]
            p = min(patience, k) - 1
            limit = np.maximum(seen.min(1) * ratio, np.partition(seen, p, axis=1)[:, p])
            go = np.isfinite(value) & (value <= limit[:, None])
            keep = go.any(1)
            if not keep.any():
                break
            best, go, todo, value = best[keep], go[keep], todo[keep], value[keep]
            # Places not worth going on from are replaced by the best one.
            first = np.argmin(np.where(go, value, np.inf), axis=1)[:, None]
            best = np.where(go, best, np.take_along_axis(best, first, 1))
            gone[todo[:, None], best] = True
            at = self.graph[best].reshape(len(todo), -1)
        return d, d <= d.min(1, keepdims=True) * ratio

    def lists_of(self, x: np.ndarray, ratio: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of indexed vectors: the nearest list, and up to
        ``replicas`` in all whose centroid is within ``ratio`` of its distance."""
        d, near = self.walk(x, ratio)
        w = min(replicas, len(self.c))
        first = np.argpartition(d, w - 1, axis=1)[:, :w] if w < len(self.c) else np.tile(np.arange(w), (len(x), 1))
        kept = np.take_along_axis(near, first, 1)
        row, col = np.nonzero(kept)
        return row, first[row, col]


def augment(x: np.ndarray, largest: float) -> np.ndarray:
    """Indexed vectors with the component that makes all norms the largest one."""
    rest = np.sqrt(np.maximum(largest * largest - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def as_queries(q: np.ndarray, largest: float) -> np.ndarray:
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    return np.concatenate([q / norm * largest, np.zeros((len(q), 1))], axis=1)


def fit(sample: np.ndarray, largest: float, k: int) -> Centroids:
    x = augment(sample, largest)
    c = balanced_centroids(x, max(1, min(k, len(x) // 2)))
    step = max(1, len(c) // 8)
    return Centroids(c, neighbour_graph(c), np.arange(0, len(c), step), largest)


# -- tables --------------------------------------------------------------------
def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "ann")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, each once; an id may have several."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if size is None:
        return rows.limit(0)
    return rows.filter(F.size("v") == size.d).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit_index(rows: DataFrame, sample_rows: int, list_size: int, max_centroids: int) -> Centroids | None:
    """Centroids from at most ``sample_rows`` of the distinct vectors ``rows``
    (those with the smallest hash), in one task."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not facts.n:
        return None
    largest, k = float(np.sqrt(facts.m)), min(max_centroids, max(1, facts.n // list_size))

    def run(batches):
        parts = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
        ids, x = np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])
        x = x[np.lexsort((*x.T[::-1], ids))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, largest, k))], pa.binary())], names=["model"])

    sample = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(sample_rows).select("id", "v")
    return pickle.loads(sample.coalesce(1).mapInArrow(run, "model binary").first().model)


def nearest(vectors: DataFrame, queries, top: int = 20, index_ratio: float = 1.04, query_ratio: float = 1.2,
            replicas: int = 4, list_size: int = 100, sample_rows: int = 20_000, max_centroids: int = 4096,
            part_rows: int = 2000, shard_bytes: int = 16 << 20,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): the ``top`` nearest others found for each
    vector whose id satisfies ``queries`` (a function of the id column)."""
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = _written(usable(vectors, id_col, vector_col))
    # Only the top + 1 smallest ids of equal vectors can be results.
    same = Window.partitionBy("v").orderBy("id")
    able = _written(rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= top + 1))
    index = fit_index(able.filter("place = 1"), sample_rows, list_size, max_centroids)
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)           # max_centroids rows at most

    def assign(batches):
        found = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _matrix(part.column(1))
                row, lists = found.lists_of(augment(x, found.largest), index_ratio, replicas)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.int32())], names=["id", "v", "list"])

    postings = _written(able.select("id", "v").mapInArrow(assign, "id long, v array<double>, list int"))
    sizes = {r.list: r.n for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a list
    width = len(index.c[0]) - 1
    shards = max(1, -(-sum(sizes.values()) * width * 8 // shard_bytes))
    parts = np.array([-(-sizes.get(k, 0) // part_rows) for k in range(len(index.c))])
    first = np.concatenate([[0], np.cumsum(parts)])        # number of each list's first part
    shared_parts = spark.sparkContext.broadcast((parts, first))

    def number(batches):
        """Postings with the number of their part and its shard."""
        parts_, first_ = shared_parts.value
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            # By vector too: an id with very many vectors fills no part.
            firsts = np.ascontiguousarray(_matrix(batch.column(1))[:, 0]).view(np.uint64)
            mixed = ((ids.astype(np.uint64) ^ firsts) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = first_[lists] + (mixed % parts_[lists].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part % shards, pa.int32()), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), pa.array(part.astype(np.int32)))], names=names)

    def route(batches):
        """Queries, once for each shard that holds parts of their lists."""
        found, (parts_, first_) = shared.value, shared_parts.value
        sized = np.array([sizes.get(k, 0) for k in range(len(found.c))])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                d, near = found.walk(as_queries(_matrix(part.column(1)), found.largest), query_ratio)
                at, shard, wanted = [], [], []
                for i in range(part.num_rows):
                    lists = np.flatnonzero(near[i])
                    if sized[lists].sum() < 4 * replicas * (top + 1):     # too few vectors there: all lists
                        lists = np.arange(len(found.c))
                    numbers = np.concatenate([np.arange(first_[k], first_[k] + parts_[k]) for k in lists])
                    for s in np.unique(numbers % shards):
                        at.append(i)
                        shard.append(s)
                        wanted.append(numbers[numbers % shards == s].astype(np.int32))
                taken = part.take(pa.array(at, pa.int64()))
                cuts = np.concatenate([[0], np.cumsum([len(w) for w in wanted])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(np.ones(len(at), np.int32)), *taken.columns[:2],
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(wanted) if wanted else np.zeros(0, np.int32)))], names=names)

    names = ["shard", "role", "id", "v", "parts"]
    five = "shard int, role int, id long, v array<double>, parts array<int>"
    asked = rows.filter(queries(F.col("id"))).select("id", "v").mapInArrow(route, five)
    dealt = (postings.mapInArrow(number, five).unionAll(asked)
                     .repartition("shard").sortWithinPartitions("shard", "role", "id"))

    def search(batches):
        """Per shard: its parts are held (bounded bytes), its queries streamed."""
        shard, held = None, None
        for batch in batches:
            shard_no, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(shard_no.astype(np.int64) * 2 + roles)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                run = batch.slice(a, b - a)
                if shard_no[a] != shard:
                    shard, held = shard_no[a], []
                ids, x = run.column(2).to_numpy(), _matrix(run.column(3))
                if roles[a] == 0:
                    held.append((ids, x, np.asarray(run.column(4).flatten())))
                    continue
                if isinstance(held, list):
                    held = _by_part(held)
                for c in range(0, len(ids), 512):
                    wanted = run.column(4).slice(c, 512)
                    yield _best(ids[c:c + 512], x[c:c + 512], wanted, held, top)

    found = dealt.mapInArrow(search, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
                 .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
                 .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _by_part(held) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids in order, their vectors, and where each id starts, by part."""
    if not held:
        return {}
    ids, x, part = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((ids, part))
    ids, x, part = ids[order], x[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    spans = zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)])
    return {int(part[a]): (ids[a:b], x[a:b], np.flatnonzero(np.diff(ids[a:b], prepend=ids[a] - 1))) for a, b in spans}


def _best(qid: np.ndarray, q: np.ndarray, wanted: pa.Array, held: dict, top: int) -> pa.RecordBatch:
    """The ``top`` best of the wanted parts for each query, scored exactly."""
    offsets = np.asarray(wanted.offsets)
    asked = np.asarray(wanted.flatten())
    owner = np.repeat(np.arange(len(qid)), np.diff(offsets))
    hits: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in qid]
    order = np.argsort(asked, kind="stable")
    cuts = np.flatnonzero(np.diff(asked[order])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if a == b or int(asked[order[a]]) not in held:
            continue
        ids, x, starts = held[int(asked[order[a]])]
        mine = owner[order[a:b]]
        rough = q[mine] @ x.T
        rough[ids[None, :] == qid[mine][:, None]] = -np.inf
        # The threshold counts ids, not rows.
        by_id = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
        for i, r, g in zip(mine, rough, by_id):
            if len(g) > top:                                  # with room for rounding
                least = np.partition(g, len(g) - top)[len(g) - top]
                keep = np.flatnonzero(r >= least - 1e-9 * (1 + abs(least)))
            else:
                keep = np.flatnonzero(np.isfinite(r))
            hits[i].append((ids[keep], x[keep], r[keep]))
    out_q, out_i, out_s = [], [], []
    for i, parts in enumerate(hits):
        if not parts:
            continue
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        good = ids != qid[i]
        ids, score = ids[good], (x[good] * q[i]).sum(axis=1)
        ranked = np.lexsort((ids, -score))
        best = ranked[np.sort(np.unique(ids[ranked], return_index=True)[1])[:top]]
        out_q += [int(qid[i])] * len(best)
        out_i.append(ids[best])
        out_s.append(score[best])
    empty = np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_i) if out_i else empty.astype(np.int64)),
         pa.array(np.concatenate(out_s) if out_s else empty)], names=["query_id", "id", "score"])
