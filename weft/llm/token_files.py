"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Format.  A folder of Parquet files; each row is one self-contained *block* of
consecutive documents in ascending id order:

    shard, block     place in the order: all of shard 0, then shard 1, ...
    base             ids of the shard before this block
    doc_ids, counts  per document its id and number of tokens
    ranked           the block's token ids, most frequent first (uint32 LE)
    control          2 bits a token, 4 tokens a byte, lowest bits first:
                     bytes of the token's rank less one
    data             the ranks' bytes, little-endian, 1 to 4 a token

Ranks are those of the block, so frequent tokens take one byte; a block can be
decoded, lost and rewritten alone.  Control bytes are apart from data bytes:
the decoder looks up a control byte's four lengths in a 256-row numpy table and
finds all places by one cumulative sum.

Plan: one shuffle (the texts, by range of id) and a narrow write.  Blocks are
cut by bytes, not by document or source, so neither a hot source nor a long
text makes a large one; the only driver-side table has one row a shard.

Results: a null or empty text is a document of just the end id; equal ids are
ordered by text, a null id comes first; repeated rows are written each; other
columns are not looked at; an empty table gives an empty folder.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb

#: Control byte -> the lengths of its four tokens.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of a block's ids."""
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    ranked = np.argsort(-seen, kind="stable")[:np.count_nonzero(seen)].astype("<u4")
    rank_of = np.zeros(len(seen), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids]
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        if len(ranked) >> bits:
            size += ranks >> np.uint32(bits) != 0
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[at] = ranks & np.uint32(255)
    for k in (1, 2, 3):
        if len(ranked) >> 8 * k:
            more = np.flatnonzero(size > k)
            data[at[more] + k] = ranks[more] >> np.uint32(8 * k) & np.uint32(255)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return ranked.tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write blocks under ``path``."""
    text = wb.tokenizer_json(tokenizer_path)
    key = wb.key_of(text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(text)

    def run(batches):
        encoder = wb.held("bpe", key, lambda: wb.WordBPE(shared.value))
        shard, block, base = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = wb.text_array(batch.column(1))
            for a, n in wb.slices(texts):
                e = encoder.encode(texts.slice(a, n))
                ids = np.insert(e.ids, e.offsets[1:], end_id)
                ranked, control, data = encode_block(ids)
                doc_ids = batch.column(0).slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), doc_ids),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(np.diff(e.offsets) + 1, pa.int64())),
                     *(pa.array([x], pa.binary()) for x in (ranked, control, data))], names=names)
                block += 1
                base += len(ids)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"shard int, block int, base long, doc_ids array<{id_type}>, counts array<long>, "
              "ranked binary, control binary, data binary")
    names = [c.split()[0] for c in schema.split(", ")]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "t")
         .mapInArrow(run, schema).write.mode("overwrite").parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded
    from the files.  ``start``: ids of all documents before it."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, at = {}, 0
    for r in sorted(totals.collect()):          # one row a shard: as many as range partitions at most
        before[r.shard] = at
        at += r.n

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.asarray(row["counts"], np.int64)
                ids = decode_block(int(counts.sum()), row["ranked"], row["control"], row["data"])
                ends = np.cumsum(counts)
                first = ends - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
                columns = [pa.array(row["doc_ids"], id_type), pa.array(first + before[row["shard"]] + row["base"]),
                           pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                                            pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(files.schema["doc_ids"].dataType.elementType)
    schema = (f"doc_id {files.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, "
              "ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    names = [c.split()[0] for c in schema.split(", ")]
    return files.mapInArrow(run, schema)
