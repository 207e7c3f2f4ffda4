"""Filter interaction audit over a sparse document-term matrix.

Five filters judge whole texts (words: maximal runs of other than ASCII white
space, case-sensitive):

    A  fewer than ``min_words`` words
    B  distinct words are less than ``distinct_percent`` % of the words
    C  the letters A-Z are more than ``upper_percent`` % of the code points
    D  one of ``signs`` stands in the text
    E  a smaller id has the identical text, anywhere in the table

``audit`` says for every order of the filters, step by step and per part of the
table, what each one removes.

Plan.
1. ``shards``: one narrow scan.  Some megabytes of texts become one shard of the
   matrix in compressed sparse row form (row pointers, columns, counts) over a
   dictionary of its own, beside the facts C, D and a hash of each text.
2. ``numbers``: the shards' dictionaries are cut into buckets by a hash of the
   word; a bucket goes through one task in the order of its shards, which numbers
   its distinct words.  A word counts once a shard, so a frequent word is no hot
   key, and a bucket's rows are read one shard at a time.
3. ``matrix``: each shard's columns get the global numbers; the counts move once.
4. ``flags``: row sums give A, numbers of stored entries B.
5. The rest is small: one row of 5 flags a document.  Rows of one text, part and
   label are merged before every shuffle, so a text that a third of the table
   has is a few rows a task, and E needs no join: a merged row knows how many of
   its documents have its least id.

Results: a null text is an empty one (A fails it); a null part is the empty
text; repeated rows each count, and rows that share the least id of their text
all pass E; a row with a null id has no smaller id and is none; a null label,
or no row of labels, is no 1; of several labels of an id the largest counts; an
empty table has no parts and so no rows; columns not named are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb
from weft.llm.words import hashes, split
from weft.session import scratch_path

FILTERS = "ABCDE"
#: Bytes of text in one shard, and of those that are cut into words together (a
#: longer text alone).  Dictionary entries in one bucket, about.
SHARD_BYTES, _SLICE, BUCKET_WORDS = 16 << 20, 2 << 20, 500_000
_DOC = "array<struct<id:{id},part:string,c:boolean,d:boolean,hash:binary>>"


def _row_facts(raw: np.ndarray, ends: np.ndarray, upper_percent: int, signs: str):
    """Per text: C and D."""
    def per_text(mask):
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int32))[ends])
    upper = per_text((raw >= 65) & (raw <= 90)).astype(np.int64)
    points = per_text((raw & 0xC0) != 0x80).astype(np.int64)
    marked = np.zeros(256, bool)
    marked[list(signs.encode("ascii"))] = True
    return 100 * upper > upper_percent * points, per_text(marked[raw]) > 0


class _Shard:
    """A shard while its texts are read."""

    def __init__(self):
        self.bytes = self.entries = 0
        self.rows, self.columns, self.counts, self.words, self.facts = [], [], [], [], []

    def add(self, ids: pa.Array, parts: pa.Array, texts: pa.Array, upper_percent: int, signs: str) -> None:
        words = split(texts)
        size = max(1, len(words.distinct))
        owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
        cells, counts = np.unique(owner * size + words.codes, return_counts=True)
        self.rows.append(np.bincount(cells // size, minlength=len(texts)))
        self.columns.append((cells % size + self.entries).astype(np.int32))
        self.counts.append(counts.astype(np.int32))
        self.words.append(words.distinct)
        self.entries += len(words.distinct)
        self.bytes += len(words.raw)
        c, d = _row_facts(words.raw, words.ends, upper_percent, signs)
        data = memoryview(words.raw)
        prints = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(words.ends, words.ends[1:])]
        self.facts.append(pa.StructArray.from_arrays([ids, parts, pa.array(c), pa.array(d), pa.array(prints, pa.binary())],
                                                     names=["id", "part", "c", "d", "hash"]))

    def row(self, number: int) -> pa.RecordBatch:
        """The shard's row; its parts go as they are put together."""
        merged = pa.concat_arrays(self.words).dictionary_encode()
        self.words.clear()
        places, dictionary = np.asarray(merged.indices, np.int32), merged.dictionary
        columns = np.concatenate(self.columns)
        self.columns.clear()
        np.take(places, columns, out=columns, mode="clip")
        counts = np.concatenate(self.counts)
        self.counts.clear()
        indptr = np.append(0, np.cumsum(np.concatenate(self.rows))).astype(np.int64)
        facts = pa.concat_arrays(self.facts)
        self.facts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(_one(x) for x in (indptr, columns, counts)),
             _joined(dictionary, np.array([0, len(dictionary)])), pa.array([len(dictionary)]),
             pa.ListArray.from_arrays(pa.array([0, len(facts)], pa.int32()), facts)],
            names=["shard", "indptr", "indices", "counts", "words", "n_words", "docs"])


def _one(numbers: np.ndarray) -> pa.Array:
    """A single value, the numbers' bytes, which are not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, numbers.nbytes], np.int32)), pa.py_buffer(numbers)])


def _joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Runs of words as one text each (no word has a space)."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _rows_of(batches, number: int, upper_percent: int, signs: str, shard_bytes: int):
    """The rows of a task's shards, numbered from ``number`` on."""
    shard = _Shard()
    for batch in batches:
        ids, parts, texts = batch.column(0), batch.column(1), wb.text_array(batch.column(2))
        for a, m in wb.slices(texts, min(_SLICE, shard_bytes)):
            # Taken, not sliced: a slice would hold its whole batch in the shard.
            own = pa.array(range(a, a + m), pa.int32())
            shard.add(ids.take(own), parts.take(own), texts.slice(a, m), upper_percent, signs)
            if shard.bytes >= shard_bytes:
                wb.give_back()
                yield shard.row(number)
                number, shard = number + 1, _Shard()
                wb.give_back()
        # Not held while the next batch is read.
        del batch, ids, parts, texts
    if shard.facts:
        yield shard.row(number)


def shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, upper_percent: int, signs: str,
           shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, indptr, indices, counts, words, n_words, docs): the matrix by shards,
    columns as places in the shard's own ``words``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        yield from _rows_of(batches, TaskContext.get().partitionId() << 32, upper_percent, signs, shard_bytes)

    return rows.mapInArrow(wb.trimmed(run), "shard long, indptr binary, indices binary, counts binary, words string, n_words long, docs "
                           + _DOC.format(id=kind))


def numbers(matrix_shards: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(shard, bucket, places, ranks, fresh): the word at ``places`` in the shard's
    dictionary has the global number bucket * 2^32 + its rank.  ``fresh`` has the
    words that no earlier shard has, by rank.  The rows of a bucket are numbered in
    one fixed order, so a task that runs again gives the same numbers."""
    entries = matrix_shards.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-entries // bucket_words))

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words = split(batch.column(1).slice(k, 1)).words
                home = (hashes(words) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                bounds = np.searchsorted(home[order], np.arange(buckets + 1))
                held = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array(np.full(len(held), batch.column(0)[k].as_py()), pa.int64()),
                     pa.array([order[bounds[b]:bounds[b + 1]].astype(np.int32).tobytes() for b in held], pa.binary()),
                     _joined(words.take(pa.array(order)), np.append(bounds[held], bounds[-1]))],
                    names=["bucket", "shard", "places", "words"])

    def number(batches):
        bucket, known = None, {}
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                b = batch.column(0)[k].as_py()
                if b != bucket:
                    bucket, known = b, {}
                words, before = batch.column(3)[k].as_py().split(" "), len(known)
                ranks = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                out.append((ranks.tobytes(), " ".join(w for w, r in zip(words, ranks) if r >= before)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), batch.column(2), pa.array([x for x, _ in out], pa.binary()),
                 pa.array([x for _, x in out], pa.string())], names=["shard", "bucket", "places", "ranks", "fresh"])

    rows = matrix_shards.select("shard", "words").mapInArrow(wb.trimmed(cut), "bucket long, shard long, places binary, words string")
    return (rows.repartition("bucket").sortWithinPartitions("bucket", "shard")
                .mapInArrow(wb.trimmed(number), "shard long, bucket long, places binary, ranks binary, fresh string"))


def vocabulary(numbered: DataFrame) -> DataFrame:
    """(word, number) of every word, from ``numbers``."""
    # The shards before one in its bucket hold the lower ranks.
    first = F.sum(F.when(F.col("fresh") == "", 0).otherwise(F.size(F.split("fresh", " ")))).over(
        Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return (numbered.filter("fresh != ''").withColumn("first", F.coalesce(first, F.lit(0)))
                    .select("bucket", "first", F.posexplode(F.split("fresh", " ")).alias("k", "word"))
                    .select("word", (F.shiftleft("bucket", 32) + F.col("first") + F.col("k")).alias("number")))


def matrix(matrix_shards: DataFrame, numbered: DataFrame) -> DataFrame:
    """(shard, indptr, indices, counts, docs): columns are the words' global
    numbers (64 bits)."""
    held = numbered.groupBy("shard").agg(F.collect_list(F.struct("bucket", "places", "ranks")).alias("numbers"))
    joined = matrix_shards.select("shard", "indptr", "indices", "counts", "docs", "n_words").join(held, "shard", "left")
    kind = matrix_shards.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                indices = np.frombuffer(batch.column(2)[k].as_buffer(), np.int32)
                of_word = np.zeros(batch.column(5)[k].as_py(), np.int64)
                for x in batch.column(6)[k].as_py() or []:
                    of_word[np.frombuffer(x["places"], np.int32)] = (x["bucket"] << 32) + np.frombuffer(x["ranks"], np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([of_word[indices].tobytes()], pa.binary()),
                     batch.column(3).slice(k, 1), batch.column(4).slice(k, 1)],
                    names=["shard", "indptr", "indices", "counts", "docs"])

    return joined.mapInArrow(wb.trimmed(run), "shard long, indptr binary, indices binary, counts binary, docs " + _DOC.format(id=kind))


def flags(csr: DataFrame, min_words: int, distinct_percent: int) -> DataFrame:
    """(id, part, hash, n_words, n_distinct, bits) of every document: bits has A
    as 1, B as 2, C as 4, D as 8."""
    kind = csr.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ptr = np.frombuffer(batch.column(0)[k].as_buffer(), np.int64)
                counts = np.frombuffer(batch.column(1)[k].as_buffer(), np.int32)
                total = np.diff(np.append(0, np.cumsum(counts, dtype=np.int64))[ptr])
                distinct = np.diff(ptr).astype(np.int64)
                facts = batch.column(2).slice(k, 1).flatten()
                c, d = (np.asarray(facts.field(x).cast(pa.uint8())) for x in ("c", "d"))
                bits = (total < min_words) + 2 * (100 * distinct < distinct_percent * total) + 4 * c + 8 * d
                yield pa.RecordBatch.from_arrays(
                    [facts.field("id"), facts.field("part"), facts.field("hash"), pa.array(total), pa.array(distinct),
                     pa.array(bits.astype(np.int32))], names=["id", "part", "hash", "n_words", "n_distinct", "bits"])

    return csr.select("indptr", "counts", "docs").mapInArrow(
        wb.trimmed(run), f"id {kind}, part string, hash binary, n_words long, n_distinct long, bits int")


def outcomes(flagged: DataFrame, labels: DataFrame, label_id_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail (E
    is 16), and how many of them have quality and toxic 1."""
    marked = (labels.select(F.col(label_id_col).alias("id"), F.col("quality").alias("q"), F.col("toxic").alias("x"))
                    .filter("id IS NOT NULL").groupBy("id").agg(F.max("q").alias("q"), F.max("x").alias("x")))
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).cast("int").alias(c)
    merged = (flagged.groupBy("id", "part", "hash", "bits").agg(F.count(F.lit(1)).alias("n"))
                     .join(marked, "id", "left").select("id", "part", "hash", "bits", "n", one("q"), one("x")))
    known = F.col("id").isNotNull()
    same = merged.groupBy("hash", "part", "bits", "q", "x").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("id", "n"))).alias("low"))
    # A few rows a text: its parts and labels.
    least = F.min("low.id").over(Window.partitionBy("hash"))
    copies = F.col("known") - F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    split_up = (same.withColumn("least", least).withColumn("copies", copies)
                    .select("part", "bits", "q", "x", F.explode(F.array(
                        F.struct(F.lit(0).alias("e"), (F.col("n") - F.col("copies")).alias("n")),
                        F.struct(F.lit(16).alias("e"), F.col("copies").alias("n")))).alias("y")))
    return (split_up.groupBy("part", (F.col("bits") + F.col("y.e")).alias("mask"))
                    .agg(F.sum("y.n").alias("n"), F.sum(F.col("q") * F.col("y.n")).alias("good"),
                         F.sum(F.col("x") * F.col("y.n")).alias("toxic")))


def orders_table(cells: DataFrame) -> DataFrame:
    """The audit from ``outcomes``: a row per part, order of the filters and step."""
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    bit = lambda k: F.expr(f"shiftleft(1, ascii(substring(filter_order, {k}, 1)) - ascii('A'))")
    steps = F.array(*[F.struct(F.lit(k).alias("step"), bit(k).alias("own"),
                               sum((bit(j) for j in range(1, k)), F.lit(0)).alias("earlier")) for k in range(1, len(FILTERS) + 1)])
    rows = (cells.select("*", F.explode(orders).alias("filter_order"))
                 .select("*", F.explode(steps).alias("s")).select("*", "s.*"))
    fails, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    table = rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"))
    every = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))       # one row an order
    return table.withColumn("shapley", F.sum("removed").over(every))


def audit(docs: DataFrame, labels: DataFrame, min_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10,
          signs: str = "#$%&*|", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley); ``labels``: id_col, quality, toxic.  Reads the texts once
    and writes the shards and the words' numbers to scratch folders."""
    spark = docs.sparkSession
    path = scratch_path(spark, "filter-audit")
    shards(docs, id_col, text_col, part_col, upper_percent, signs).write.parquet(f"{path}/shards")
    own = spark.read.parquet(f"{path}/shards")
    numbers(own).write.parquet(f"{path}/numbers")
    csr = matrix(own, spark.read.parquet(f"{path}/numbers"))
    return orders_table(outcomes(flags(csr, min_words, distinct_percent), labels, id_col))
