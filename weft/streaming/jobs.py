"""Structured Streaming jobs for the source's incremental behaviour.

All read a file source with a fixed schema, keep progress in a checkpoint
directory (restart continues where it stopped, like the source's resumable
append), and run with ``trigger(availableNow=True)`` so a run processes what
is there and stops.  Output sinks are parquet tables (exactly-once with the
checkpoint); the complete-mode roll-up is written per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.session import scratch_path
from weft.sources.commits import CommitLog
from weft.streaming import ttl


def stage_json(df: DataFrame, name: str) -> str:
    """Write ``df`` as JSON files into a fresh shared directory (stream input),
    one file for each of its own partitions (times to the microsecond)."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(timestampFormat=ttl.MICROS, timestampNTZFormat=ttl.MICROS_NTZ).json(path)
    return path


def _read(spark: SparkSession, src: str, schema: str, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(src)


def validate_append(spark: SparkSession, src: str, schema: str, reason_fn,
                    out: str | None = None, ckpt: str | None = None,
                    max_files: int | None = None) -> DataFrame:
    """Validate each new file's rows and append them with their reason."""
    out = out or scratch_path(spark, "t1-out")
    ckpt = ckpt or scratch_path(spark, "t1-ckpt")
    s = _read(spark, src, schema, max_files)
    q = (reason_fn(s).writeStream.format("parquet").option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


def running_totals(spark: SparkSession, src: str, schema: str, by: str, aggs: list,
                   out: str | None = None, ckpt: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """Running totals per group, updated after every micro-batch
    (complete mode; the state holds one row per group).  Each micro-batch is a
    commit that replaces the totals, once a batch however often it is tried, so a
    crash leaves the totals of the batch before."""
    out = out or scratch_path(spark, "t2-out")
    ckpt = ckpt or scratch_path(spark, "t2-ckpt")
    s = _read(spark, src, schema, max_files)
    totals = s.groupBy(by).agg(*aggs)

    log = CommitLog(spark, out)

    def publish(batch: DataFrame, epoch: int) -> None:
        log.commit(f"{ckpt} {epoch}", {"totals": batch}, replace=("totals",))
    q = (totals.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return log.read("totals")


def dedup_within_ttl(spark: SparkSession, src: str, schema: str, key: str, ts: str,
                     ttl_seconds: int = 30 * 86_400, delay: str = "1 day", out: str | None = None,
                     ckpt: str | None = None, max_files: int | None = None, buckets: int = ttl.BUCKETS) -> DataFrame:
    """Requests of which no accepted one of the same key lies within the TTL
    before (see ``ttl``).  The sink ``out`` has those that are decided; the result
    also has those that pass if the stream brings no more."""
    out = out or scratch_path(spark, "t3-out")
    ckpt = ckpt or scratch_path(spark, "t3-ckpt")
    s = _read(spark, src, schema, max_files)
    q = (ttl.pass_within_ttl(s, key, ts, ttl_seconds, delay, buckets).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out).unionByName(ttl.still_waiting(spark, ckpt, s.schema, ttl_seconds))
