"""The folder that all executors share, and tables pinned in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder of its own; on a
    cluster executors would not see it, so there it is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kvloom-")
    if not held.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def modified(spark: SparkSession, file: str) -> int:
    """When a file of any file system was last written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder.

    For rows whose place comes from range partitioning: sampled bounds may
    differ when a plan is computed twice.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
