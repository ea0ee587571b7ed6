"""Shared plumbing: scratch tables, bounded broadcasts, Arrow batch mapping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.sources.scratch import shared_folder

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"

_left_behind: list[tuple[SparkSession, str]] = []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their module path already has it."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(package.parent) in on_path or getattr(context, "_kvloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="kvloom-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._kvloom_shipped = True


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage in storage that outlives executors, so a lost
    executor costs only its own running tasks.  ``batch_rows`` bounds the Arrow
    batches of this write, for functions whose memory follows the batch.
    """
    spark = session_of(df)
    ship_package(spark)
    path = f"{shared_folder(spark)}/kvloom-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_ROWS)
    if batch_rows:
        spark.conf.set(_BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    _left_behind.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch() -> None:
    """Delete the scratch tables written by this process; results read from them must be saved before."""
    while _left_behind:
        spark, path = _left_behind.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
            return


atexit.register(clear_scratch)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only when ``rows``, a count already made, is within ``most``; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def map_batches(df: DataFrame, columns: list[Column], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """Run ``fn`` over Arrow batches of the given columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    ship_package(session_of(df))
    return df.select(*columns).mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]
