"""Session and scratch-location helpers.

Lineage is cut with ``DataFrame.checkpoint()`` or a table written under the
cluster's shared ``spark.checkpoint.dir``.  The setting is read from the
session; only when it is unset (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "weft",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests, the bench and local runs.

    On a cluster the session comes from the launcher; of a running session only
    these SQL settings are changed.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.driver.memory", "12g")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root.  Where it is unset a local one is made
    for a local master; on a cluster that would be another folder on each
    machine, so there it is an error."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weft-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (where it is not installed there:
    UDFs import it by name).  Once a session."""
    import shutil
    if getattr(spark, "_weft_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="weft-ship-"), "weft_package")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    spark._weft_shipped = True


#: Scratch folders made by this process, for ``clear_scratch``.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders made so far, and return how many there were.

    Results are read lazily from them, so this is for the end of a job, when
    what it returned has been written or collected."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_SCRATCH)
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
