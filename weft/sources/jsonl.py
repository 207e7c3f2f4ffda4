"""JSON / JSONL scans and sinks.

Every scan takes an explicit schema (no inference: the source's loader fails
on type conflicts, which is why it needed a separate type-repair step).
Unions of types are read as ``variant`` columns and normalised later.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad"


def _with_bad(schema: StructType | str, spark: SparkSession) -> StructType:
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if BAD not in st.fieldNames():
        st = StructType(st.fields + [StructField(BAD, StringType(), True)])
    return st


def read_jsonl_tolerant(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Parse each line; bad lines are logged to a side table, good rows go on."""
    df = (spark.read.schema(_with_bad(schema, spark)).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", BAD).json(path))
    df = df.cache()   # Spark requires it before filtering on the corrupt-record column alone
    return df.where(F.col(BAD).isNull()).drop(BAD), df.where(F.col(BAD).isNotNull()).select(BAD)


def read_jsonl_all_or_nothing(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank lines skipped; any bad line -> empty result (the source's
    ``load_existing_data``).  One count of bad rows decides."""
    good, bad = read_jsonl_tolerant(spark, path, schema)
    return good.limit(0) if bad.limit(1).count() > 0 else good


def read_jsonl_strict(spark: SparkSession, path: str, schema) -> DataFrame:
    """S3: fail on the first bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_named_dataset(spark: SparkSession, root: str, subset: str | None = None,
                       split: str | None = None, language: str | None = None) -> DataFrame:
    """A dataset stored as parquet partitioned by subset/split[/language];
    the filters prune partitions (no files outside them are opened)."""
    df = spark.read.parquet(root)
    for col, val in (("subset", subset), ("split", split), ("language", language)):
        if val is not None and col in df.columns:
            df = df.where(F.col(col) == val)
    return df


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append finished records (UTF-8, non-ASCII kept)."""
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite the output."""
    df.write.mode("overwrite").json(path)


def verified_write(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write to a staging directory while observing the row count, read it
    back, compare, and only then publish (the staging path becomes the
    output).  Raises on mismatch; the previous output stays untouched."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{_dt.datetime.now(_dt.timezone.utc):%Y%m%d%H%M%S%f}"
    obs = Observation("verified_write")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(fmt).save(staging)
    written = obs.get["n"]
    back = spark.read.format(fmt).load(staging).count()
    if back != written:
        raise IOError(f"verified write failed: wrote {written}, read back {back}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(staging)
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    previous = jvm.org.apache.hadoop.fs.Path(staging + ".previous")
    had = fs.exists(dst)
    if had and not fs.rename(dst, previous):
        raise IOError(f"could not put {path} aside")
    if not fs.rename(src, dst):
        if had:
            fs.rename(previous, dst)          # the output is again what it was
        raise IOError(f"could not publish {staging} to {path}")
    return int(written)


def write_run(df: DataFrame, root: str, run_ts: str | None = None, fmt: str = "parquet") -> str:
    """Every run goes to its own ``run=<ts>`` partition; older runs stay
    as the backups."""
    ts = run_ts or f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%d_%H%M%S}"
    out = f"{root.rstrip('/')}/run={ts}"
    df.write.mode("error").format(fmt).save(out)
    return out


def write_audit(df: DataFrame, root: str, status_col: str = "status") -> None:
    """Skipped / failed records appended, one directory per status."""
    df.write.mode("append").partitionBy(status_col).json(root)


def write_monitor_csv(df: DataFrame, path: str) -> None:
    """The four monitoring columns, with a header, by the names of training
    examples or, where ``df`` lacks one of those, by their short names."""
    cols = ["input_content_original", "input_content_original_length", "input_content_truncated", "input_content_truncated_length"]
    short = ["original_text", "original_length", "truncated_text", "truncated_length"]
    names = short if set(short) <= set(df.columns) and not set(cols) <= set(df.columns) else cols
    df.select(*names).write.mode("overwrite").option("header", True).csv(path)


def publish_split(df: DataFrame, root: str, split: str = "test") -> None:
    """Publish a result table under a named split partition."""
    df.withColumn("split", F.lit(split)).write.mode("append").partitionBy("split").parquet(root)
