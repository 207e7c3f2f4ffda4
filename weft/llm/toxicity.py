"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

Features: the distinct byte n-grams (of 5, 6 and 7 bytes) of the lower-cased text, white
space as one kind of sign, hashed to 2^20 numbers.  With p and q the smoothed
document frequencies of a feature among toxic and other texts, its ratio is
r = ln((p / |p|) / (q / |q|)); the features with the clearest difference in
frequency are kept, each with value r, and a logistic regression (L2) is fitted
to those values.

Training reads a bounded sample: of each class the ``per_class`` labelled rows
with the smallest hash of their id (never a row whose id's crc32 leaves 0 modulo
5).  Scoring is one narrow scan with a weight table of fixed size.

Results: labels other than 0 and 1 are no labels; of several labels for an id
the largest counts; a null or empty text gets the score of no features; texts of
any length are read whole; repeated rows get equal scores; without labelled rows
of both classes every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb
from weft.session import scratch_path

BITS, SIZES = 20, (5, 6, 7)
#: Bytes up to the space become the space.
_PLAIN = np.maximum(np.arange(256), 0x20).astype(np.uint8)
#: Bytes of text whose n-grams are held in memory together.
_SLICE = 1 << 20
#: Spread of the sample's rows over tasks; its size is bounded, so this is too.
_SAMPLE_TASKS = 4


def held_out(id_col: str):
    """True for rows that never train: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams(texts: pa.Array):
    """(text number, feature) of every n-gram of a run of texts, for each n."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    b = _PLAIN[raw].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    h = b.copy()
    for n in range(2, max(SIZES) + 1):
        if len(b) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1:]
        if n in SIZES:
            inside = owner[:-(n - 1)] == owner[n - 1:]
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            yield owner[:-(n - 1)][inside], ((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))[inside]


def distinct_features(texts: pa.Array, keep: np.ndarray | None = None):
    """(text number, feature) without repeats; ``keep``: only features marked there."""
    owners, features = [], []
    for owner, f in grams(texts):
        if keep is not None:
            at = np.flatnonzero(keep[f])
            owner, f = owner[at], f[at]
        owners.append(owner.astype(np.int64) << BITS | f)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(owners))
    return pairs >> BITS, pairs & (1 << BITS) - 1


@dataclasses.dataclass
class Model:
    weights: np.ndarray        # float32, 2^BITS
    bias: float


def _fit(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on features of value ``ratio``: L-BFGS with
    backtracking, on the mean loss plus ``l2`` / (2 n) times the squared weights."""
    y = np.array([r[0] for r in rows], np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    feature = np.concatenate([r[1] for r in rows]) if len(rows) else np.zeros(0, np.int64)
    value, n, m = ratio[feature], len(y), len(ratio)

    def loss(x):
        z = np.bincount(doc, value * x[feature], minlength=n) + x[m]
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.append(np.bincount(feature, miss[doc] * value, minlength=m) + l2 * x[:m], miss.sum()) / n
        return (np.logaddexp(0, z) - y * z).mean() + l2 / (2 * n) * (x[:m] @ x[:m]), grad

    x = np.zeros(m + 1)
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, u in reversed(past):
            a = (s @ d) / (s @ u)
            kept.append(a)
            d = d - a * u
        if past:
            s, u = past[-1]
            d = d * (s @ u) / (u @ u)
        for (s, u), a in zip(past, reversed(kept)):
            d = d + s * (a - (u @ d) / (s @ u))
        t, slope = (1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12))), g @ d
        while True:
            fx, gx = loss(x + t * d)
            if fx <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, u = t * d, gx - g
        done = f - fx < 1e-8 * max(1.0, abs(f))
        x, f, g = x + s, fx, gx
        if done:
            break
        if s @ u > 1e-12:
            past = [*past, (s, u)][-8:]
    return x[:m], float(x[m])


def _choose(seen: np.ndarray, n: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The clearest features and their ratios, from the document frequencies of
    all of them in each class of ``n`` texts."""
    if not n.all():
        return np.zeros(0, np.int64), np.zeros(0)
    q, p = seen + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio -= np.log((n[1] + 2) / p.sum()) - np.log((n[0] + 2) / q.sum())   # a feature as frequent in both has 0
    rate0, rate1 = seen[0] / n[0], seen[1] / n[1]
    pooled = seen.sum(0) / n.sum()
    clear = np.abs(rate1 - rate0) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    clear[seen.sum(0) < 5] = 0
    chosen = np.sort(np.argsort(-clear, kind="stable")[:features])
    chosen = chosen[clear[chosen] > 2.0]
    return chosen, ratio[chosen]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, features: int = 8192, l2: float = 1.0,
          steps: int = 100, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``per_class`` labelled rows of each class."""
    spark = docs.sparkSession
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                    .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
                    .groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id")))
    share = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    weights = np.zeros(1 << BITS, np.float32)
    prior = (share.pos + 0.5) / (share.n + 2.0)
    empty = Model(weights, float(np.log(prior / (1 - prior))))
    order = [F.xxhash64("id"), F.col("id")]
    sample = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionAll(part)
    path = scratch_path(spark, "toxicity-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    # 2 * per_class ids and labels at most: a bounded broadcast.  A text that
    # stands under one id many times counts once, so copies of it bring nothing.
    (rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
         .repartition(_SAMPLE_TASKS, "id").write.parquet(path))
    sample = spark.read.parquet(path)

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        n = [0, 0]
        for batch in batches:
            texts, ys = wb.text_array(batch.column(1)), np.asarray(batch.column(0))
            for a, m in wb.slices(texts, _SLICE):
                doc, f = distinct_features(texts.slice(a, m))
                for y in (0, 1):
                    seen[y] += np.bincount(f[ys[a:a + m][doc] == y], minlength=1 << BITS).astype(np.int32)
                    n[y] += int((ys[a:a + m] == y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()),
                                          pa.array([seen[0].tobytes(), seen[1].tobytes()], pa.binary())], names=["y", "n", "seen"])

    def choose(batches):
        seen, n = np.zeros((2, 1 << BITS)), np.zeros(2)
        for batch in batches:
            for k in range(batch.num_rows):
                y = batch.column(0)[k].as_py()
                seen[y] += np.frombuffer(batch.column(2)[k].as_buffer(), np.int32)
                n[y] += batch.column(1)[k].as_py()
        chosen, value = _choose(seen, n, features)
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([chosen.tobytes()], pa.binary()),
                                          pa.array([value.tobytes()], pa.binary())], names=["n0", "n1", "chosen", "value"])

    # Two fixed-size count tables for each of the sample's few tasks meet in one
    # task; the driver gets the chosen features only.
    counts = sample.select("y", "t").coalesce(_SAMPLE_TASKS).mapInArrow(wb.trimmed(count), "y int, n long, seen binary")
    made = counts.repartition(1).mapInArrow(wb.trimmed(choose), "n0 long, n1 long, chosen binary, value binary").first()
    chosen, value = (np.frombuffer(made.chosen, np.int64), np.frombuffer(made.value, np.float64)) if made else ([], [])
    if not len(chosen):
        return empty

    def fit(batches):
        rows = []
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        for batch in batches:
            texts, ys = wb.text_array(batch.column(1)), np.asarray(batch.column(0))
            for a, m in wb.slices(texts, _SLICE):
                doc, f = distinct_features(texts.slice(a, m), place >= 0)
                cuts = np.searchsorted(doc, np.arange(m + 1))
                rows += [(int(ys[a + i]), place[f[cuts[i]:cuts[i + 1]]]) for i in range(m)]
        w, b = _fit(rows, value, l2, steps)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    fitted = sample.select("y", "t").coalesce(1).mapInArrow(wb.trimmed(fit), "w binary, b double").first()
    weights[chosen] = np.frombuffer(fitted.w, np.float64) * value
    # The sample's classes are not in the labels' proportion.
    shift = np.log(prior / (1 - prior)) - np.log(made.n1 / made.n0)
    return Model(weights, float(fitted.b + shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (score >= 0.5)."""
    some = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((some, model.weights[some], model.bias))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        some, values, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[some] = values
        keep = weights != 0
        for batch in batches:
            texts = wb.text_array(batch.column(at))
            out = []
            for a, n in wb.slices(texts, _SLICE):
                doc, f = distinct_features(texts.slice(a, n), keep)
                z = np.bincount(doc, weights[f], minlength=n) + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))],
                                             names=[*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType
    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    scored = docs.mapInArrow(wb.trimmed(run), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
