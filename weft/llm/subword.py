"""Quality: supervised subword embeddings.

A text's features are its words, as written, and the character n-grams (``SIZES``
code points) of each word between ``<`` and ``>``, and one feature that every
text has; a word that repeats the one before it is one and the same mark, so that
repetition is a feature whatever word it is of.  All are hashed to 2^``BITS`` numbers, each with a vector.  The vectors
of all features of a text (as often as they occur) are averaged, and a linear
layer with softmax gives the probability of each class.  Vectors and layer are
trained together by stochastic gradient descent, a text at a time in hashed
order, with a learning rate that falls to 0.

Training reads a bounded sample: of each class the ``per_class`` labelled texts
with the smallest hash of their id (never one that ``learns`` rules out), in one
task; what comes back is one number for each feature and class, as averaging and
the linear layer may change places.  Scoring is one narrow scan: the distinct
words of some megabytes of text are cut into n-grams once, and a text's sum is
that of its words.

Results: labels other than 0 and 1 are no labels; of several labels of an id the
largest counts; different texts of one labelled id are texts of their own, equal
ones count once; a null or empty text has the common feature alone; texts of any
length are read whole; repeated rows get equal scores; null ids never train;
without labelled texts of both classes every score is the smoothed share of
label 1; further columns of any name come through ``score`` unchanged.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from weft.llm import wordbpe as wb
from weft.llm.words import Words, split
from weft.session import scratch_path

BITS, SIZES = 18, (2, 3, 4)
#: Bytes of text whose n-grams are held in memory together.
_SLICE = 2 << 20
#: Number of the feature that every text has.
_COMMON = 0
#: Stands for a word that repeats the one before it; no word of a text has a space.
_AGAIN = "the word before"


def learns(id_col: str, modulus: int = 3, held: int = 1) -> Column:
    """False for rows that never train: crc32 of the id as text leaves ``held``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held, F.lit(False))


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): those of words[i] are features[bounds[i]:bounds[i + 1]],
    the word itself first, then its n-grams."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.asarray(pc.utf8_length(words), np.int64) + 2
    ends = np.append(0, np.cumsum(size))
    inner = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.empty(ends[-1], np.uint32)
    chars[ends[:-1]], chars[ends[1:] - 1] = ord("<"), ord(">")
    body = np.ones(ends[-1], bool)
    body[ends[:-1]] = body[ends[1:] - 1] = False
    chars[body] = inner
    # Words are hashed as sums of (character, place), so of any length at once.
    place = np.arange(ends[-1], dtype=np.uint64) - np.repeat(ends[:-1], size).astype(np.uint64)
    each = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ place * np.uint64(0xC2B2AE3D27D4EB4F)
    each = (each ^ each >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    each ^= each >> np.uint64(29)
    whole = np.add.reduceat(each, ends[:-1]) * np.uint64(0x94D049BB133111EB)
    owners, features = [np.arange(n)], [(whole >> np.uint64(64 - BITS)).astype(np.int32)]
    owner = np.repeat(np.arange(n), size)
    h = np.zeros(len(chars), np.uint64)
    for k in range(max(SIZES)):
        if len(chars) <= k:
            break
        h = (h[:len(chars) - k] * np.uint64(0x100000001B3)) ^ (chars[k:].astype(np.uint64) + np.uint64(1))
        if k + 1 in SIZES:
            inside = owner[:len(owner) - k] == owner[k:]
            mixed = (h[inside] + np.uint64(k + 1 << 40)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            owners.append(owner[:len(owner) - k][inside])
            features.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    owner, found = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(n + 1))


def marked_repeats(texts: pa.Array) -> Words:
    """The texts' words, where each that equals the word before it is _AGAIN."""
    words = split(texts)
    again = np.flatnonzero(words.codes[1:] == words.codes[:-1]) + 1
    if not len(again):
        return words
    inside = np.ones(len(words.codes) + 1, bool)
    inside[words.offsets] = False
    again = again[inside[again]]
    codes = words.codes.copy()
    codes[again] = len(words.distinct)
    return dataclasses.replace(words, codes=codes, distinct=pa.concat_arrays([words.distinct, pa.array([_AGAIN], words.distinct.type)]))


def _histograms(words: Words, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their shares of all the text's features) of every text."""
    found, bounds = word_features(words.distinct)
    out = []
    for i in range(texts):
        code, times = np.unique(words.codes[words.offsets[i]:words.offsets[i + 1]], return_counts=True)
        many = bounds[code + 1] - bounds[code]
        at = np.arange(many.sum()) + np.repeat(bounds[code] - (np.cumsum(many) - many), many)
        f, where = np.unique(np.append(found[at], np.int32(_COMMON)), return_inverse=True)
        count = np.bincount(where, np.append(np.repeat(times, many), 1.0))
        out.append((f, (count / count.sum()).astype(np.float32)))
    return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, dim: int, epochs: int, rate: float) -> np.ndarray:
    """Logits of every feature (2^BITS x classes) after stochastic gradient
    descent over (class, features, shares)."""
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer = np.zeros((classes, dim), np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, f, share = rows[k]
            pace = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[f]
            z = layer @ mean
            p = np.exp(z - z.max())
            miss = p / p.sum()
            miss[y] -= 1
            back = miss @ layer
            layer -= pace * np.outer(miss, mean)
            vectors[f] -= pace * np.outer(share, back)
    return vectors @ layer.T


@dataclasses.dataclass
class Model:
    logits: np.ndarray         # float32, 2^BITS x classes
    bias: np.ndarray           # of each class


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 2000, dim: int = 16, epochs: int = 5,
          least_steps: int = 10_000, rate: float = 2.0, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, each seen
    ``epochs`` times (a small sample more often: ``least_steps`` in all)."""
    spark = docs.sparkSession
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                    .filter(F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")).filter(learns("id", modulus, held)))
    share = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([share.get(0, 0), share.get(1, 0)], float)
    prior = np.log((n + 0.5) / (n.sum() + 1.0))
    empty = Model(np.zeros((1 << BITS, 2), np.float32), prior)
    if not n.all():
        return empty
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [marked.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids: a bounded broadcast.
    texts = (docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
                 .join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").distinct())
    path = scratch_path(spark, "subword-sample")
    texts.write.parquet(path)
    texts = spark.read.parquet(path)
    picked = [texts.filter(F.col("y") == y).select("y", "t", *[o.alias(f"o{k}") for k, o in enumerate([*order, F.xxhash64("t")])])
              .orderBy("o0", "o1", "o2").limit(per_class) for y in (0, 1)]

    def run(batches):
        rows = []
        for batch in batches:
            text, y = wb.text_array(batch.column(1)), np.asarray(batch.column(0))
            for a, m in wb.slices(text, _SLICE):
                rows += [(int(c), f, s) for c, (f, s) in zip(y[a:a + m], _histograms(marked_repeats(text.slice(a, m)), m))]
        seen = np.bincount([r[0] for r in rows], minlength=2)
        rounds = max(epochs, -(-least_steps // max(1, len(rows))))
        logits = fit(rows, 2, dim, rounds, rate) if seen.all() else np.zeros((1 << BITS, 2))
        yield pa.RecordBatch.from_arrays([pa.array([logits.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int64()))],
                                         names=["logits", "seen"])

    sample = picked[0].select("y", "t").unionAll(picked[1].select("y", "t"))
    got = sample.coalesce(1).mapInArrow(wb.trimmed(run), "logits binary, seen array<long>").first()
    seen = np.array(got.seen if got else [0, 0], float)
    if not seen.all():
        return empty
    # The sample's classes are not in the labels' proportion.
    bias = prior - np.log(seen / seen.sum())
    return Model(np.frombuffer(got.logits, np.float32).reshape(-1, 2), bias)


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """texts x classes."""
    words = marked_repeats(texts)
    found, bounds = word_features(words.distinct)
    many = np.append(0, np.cumsum(np.diff(bounds)[words.codes]))[words.offsets]
    total = np.diff(many) + 1
    z = np.empty((len(texts), model.logits.shape[1]))
    for k in range(z.shape[1]):
        of_word = np.add.reduceat(model.logits[found, k].astype(np.float64), bounds[:-1]) if len(found) else np.zeros(0)
        upto = np.append(0, np.cumsum(of_word[words.codes]))[words.offsets]
        z[:, k] = (np.diff(upto) + float(model.logits[_COMMON, k])) / total + model.bias[k]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of ``docs`` and, after them, the probability of class 1 and
    whether it is 0.5 or more.  Name the two anew where ``docs`` has such columns
    (an error otherwise: nothing is overwritten)."""
    clash = {score_col, predicted_col} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}: give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = wb.text_array(batch.column(at))
            found = [probabilities(texts.slice(a, m), shared.value)[:, 1] for a, m in wb.slices(texts, _SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))],
                                             names=[*batch.schema.names, score_col])

    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())
    return docs.mapInArrow(wb.trimmed(run), schema).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))
