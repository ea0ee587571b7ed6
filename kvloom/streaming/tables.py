"""Streams into stored tables: counters and upserts with exactly-once commits.

A micro batch is one commit.  Its number is stored in the same version as its
rows, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.operators.stages import wrapping_add
from kvloom.operators.table import KVTable
from kvloom.sources.store import Database, Delta

#: The column of batch numbers that a database needs for streams.
PROGRESS = "stream_progress"
PROGRESS_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType())])


def _once(database: Database, stream: str, batch: int, change) -> None:
    """Commit ``change`` with the batch's number, unless it has been committed."""
    if PROGRESS not in database.columns:
        raise KeyError(f"the database needs a column {PROGRESS}")

    def step(read):
        progress = KVTable(read(PROGRESS))
        done = progress.get(stream).first()
        if done is not None and done.value >= batch:
            return {}
        return change(read) | {PROGRESS: Delta(progress.put(stream, batch).written)}

    database.transact(step)


def count_into(stream: DataFrame, database: Database, column: str, name: str, key: Column, amount: Column | None = None, checkpoint: str | None = None, once: bool = True):
    """Add amounts (default 1) to the counters of a column (key, value long); returns the started query."""

    def add(batch: DataFrame, number: int) -> None:
        added = batch.groupBy(key.alias("key")).agg(F.sum(F.lit(1).cast("long") if amount is None else amount).alias("added")).where(F.col("key").isNotNull())

        def change(read):
            met = added.join(read(column), "key", "left")  # the counters of the batch only
            return {column: Delta(met.select("key", wrapping_add(F.col("value"), F.col("added")).alias("value")))}

        _once(database, name, number, change)

    return _start(stream, add, checkpoint, once)


def upsert_into(stream: DataFrame, database: Database, column: str, name: str, seq: Column, checkpoint: str | None = None, once: bool = True):
    """Put entries (key, value) into a column; within a batch the greatest ``seq`` of a key wins."""

    def put(batch: DataFrame, number: int) -> None:
        entries = batch.select("key", "value", seq.alias("seq"))
        _once(database, name, number, lambda read: {column: Delta(KVTable(read(column)).put_multi(entries).written)})

    return _start(stream, put, checkpoint, once)


def _start(stream: DataFrame, fn, checkpoint: str | None, once: bool):
    writer = stream.writeStream.foreachBatch(fn)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """(window, key, n) of tumbling windows; rows later than ``late`` are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
