"""Packing by power-of-two decomposition.

A document of L tokens (its end token included) is cut into as many pieces of
``max_len`` as fit, and the rest into the powers of two of its binary form,
longest first.  Every piece is a training sequence of its own, in the bucket of
its length: no sequence crosses documents and none is padded.  A batch is drawn
from one bucket (``write_buckets`` lays the sequences out that way).

The work is one narrow scan: each document is encoded and cut where it is read,
so neither a hot source nor a very long document gathers rows in one task.

Results: a null or empty text is a document of just its end token (one piece of
length 1); repeated rows are packed each, with their own sequences; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb


def decompose(n: int, max_len: int) -> list[int]:
    """Piece lengths of n tokens: whole ``max_len`` pieces, then the binary form."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
         cache_words: int = 500_000, slice_bytes: int = wb.SLICE_BYTES) -> DataFrame:
    """One row per sequence: id_col, start (tokens of its document before it),
    length, bucket (log2 of the length), doc_tokens, sequence_id, offset (0: a
    sequence is one piece), ids_crc32 and, with ``with_ids``, the ids.

    ``sequence_id`` numbers sequences within a task's input and carries the
    task's number in its high bits: unique, and the same when a lost task of the
    same scan runs again.  ``max_len`` must be a power of two.  A Python worker
    keeps the ids of ``cache_words`` words and encodes ``slice_bytes`` of text at
    a time: fewer take less memory and more time, for the same rows."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    text = wb.tokenizer_json(tokenizer_path)
    key = wb.key_of(f"{cache_words} {text}")
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        encoder = wb.held("bpe", key, lambda: wb.WordBPE(shared.value, cache_words))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = wb.text_array(batch.column(1))
            for a, n in wb.slices(texts, slice_bytes):
                e = encoder.encode(texts.slice(a, n))
                doc, start, length, total, crc, flat = [], [], [], [], [], []
                for i in range(n):
                    ids = np.append(e.ids[e.offsets[i]:e.offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for size in decompose(len(ids), max_len):
                        piece = ids[at:at + size]
                        doc.append(a + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        if with_ids:
                            flat.append(piece.view("<i4"))
                        at += size
                rows = len(doc)
                columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()),
                           pa.array(np.log2(np.asarray(length)).astype(np.int32), pa.int32()),
                           pa.array(total, pa.int64()),
                           pa.array(np.arange(number, number + rows), pa.int64()),
                           pa.array(np.zeros(rows, np.int64)), pa.array(crc, pa.int64())]
                number += rows
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del columns, flat, e
            # One batch at a time: the next one is read into what this one held.
            del batch, texts
            wb.give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, start long, length long, bucket int, doc_tokens long, sequence_id long, "
              "offset long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences laid out by bucket, for training batches of one length each.

    Each task writes its own files in every bucket: no bucket is gathered."""
    packed.write.partitionBy("bucket").parquet(path)
