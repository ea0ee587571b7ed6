"""Bounded dataflow operators as DataFrame expressions.

An operator that numbers rows needs one order over all rows.  ``numbered``
makes it without one task for all: rows are range-partitioned by the order,
counted by partition, and numbered inside partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions.ranges import conjunction, disjunction
from kvloom.sources.scratch import pinned

every, either = conjunction, disjunction


def _placed(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with the number of their range partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pinned(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def indexed(df: DataFrame, order: list[str], name: str = "index", parts: int | None = None) -> DataFrame:
    """Rows with their 0-based number in the given order (unique, or ties are numbered in any order)."""
    placed = _placed(df, order, parts)
    local = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.row_number().over(local) - 1 + F.col("__start")).drop("__part", "__start")


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch") -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows."""
    return indexed(df, order, "__index").withColumn(name, F.floor(F.col("__index") / size)).drop("__index")


def consecutive(df: DataFrame, key: str, order: list[str], by: list[str] | None = None, name: str = "run") -> DataFrame:
    """Rows with the number of their run of equal keys; runs are numbered within ``by``, or over all rows.

    Without ``by`` it marks starts of runs across range partitions.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        start = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("long")
        return df.withColumn("__start", start).withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__start")
    blocks = _placed(df, order)
    w = Window.partitionBy("__part").orderBy(*order)
    first = F.row_number().over(w) == 1
    inner = F.when(first, F.lit(0)).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("long"))
    marked = blocks.withColumn("__inner", inner)
    place, one = F.struct(*order), F.struct(F.col(key).alias("k"))
    ends = marked.groupBy("__part").agg(F.min_by(one, place).alias("head"), F.max_by(one, place).alias("tail"), F.sum("__inner").alias("inner"))
    o = Window.orderBy("__part")
    before = F.lag("tail").over(o)
    bound = ends.withColumn("starts", F.when(before.isNull() | ~F.col("head.k").eqNullSafe(before["k"]), 1).otherwise(0))
    offset = F.sum("starts").over(o.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("inner").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    starts = bound.select("__part", offset.alias("__offset"))
    running = F.sum("__inner").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__offset") + running).drop("__part", "__inner", "__offset")


def merge_ordered(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """One ordered stream of several."""
    return reduce(DataFrame.unionByName, frames).orderBy(*order)


def take_while(df: DataFrame, condition: Column, order: list[str], by: list[str], inclusive: bool = False) -> DataFrame:
    """Rows of each group before the first that breaks the condition; with ``inclusive`` that row too."""
    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1) if inclusive else w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.coalesce(F.sum((~condition).cast("long")).over(frame), F.lit(0))
    return df.withColumn("__broken", broken).where(F.col("__broken") == 0).drop("__broken")


def take_until(df: DataFrame, condition: Column, order: list[str], by: list[str]) -> DataFrame:
    """Rows of each group up to the first that meets the condition, that row included."""
    return take_while(df, ~condition, order, by, inclusive=True)


def fold(df: DataFrame, value: str, zero: Column, step: Callable[[Column, Column], Column], by: list[str]) -> DataFrame:
    """Fold of the values of each group; ``step`` must be associative and commutative, and ``zero`` its neutral element.

    Values are folded by input partition first, so a task gathers a group's
    values of one partition, then one partial result a partition.
    """
    folded = lambda name: F.aggregate(F.collect_list(name), zero, step)
    partial = df.withColumn("__part", F.spark_partition_id()).groupBy(*by, "__part").agg(folded(value).alias("__partial"))
    return partial.groupBy(*by).agg(folded("__partial").alias("folded"))


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """A reproducible random order: by the md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def repeated(value: Column, times: int) -> Column:
    return F.array_repeat(value, times)


def backoff(turn: int, most_ms: int = 2000, spread: float = 0.3, unit: float = 0.5) -> float:
    """Milliseconds to wait before retry ``turn``: a capped power of two, moved by up to ``spread`` with ``unit`` in [0, 1]."""
    return min(most_ms, 2**turn) * (1 - spread + 2 * spread * unit)


# terminals: an action each


def to_list(df: DataFrame, most: int = 100_000) -> list:
    """All rows on the driver; more than ``most`` are an error, not cut."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return found


def to_first(df: DataFrame, order: list[str]):
    """The first row of the order, or None."""
    return df.orderBy(*order).first()


def to_any(df: DataFrame):
    return df.first()


def counted(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias(name))


def summed(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    """One row with the sum; 0 without rows."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(name))


def collected(df: DataFrame, by: list[str], **collectors: Column) -> DataFrame:
    """The collectors (aggregates) of each group, or of all rows."""
    made = [c.alias(k) for k, c in collectors.items()]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def executing(df: DataFrame, fn: Callable[[list], None], order: list[str] | None = None) -> int:
    """Call ``fn`` with the rows of each task, in order inside a task if one is given; the number of rows.

    A task that is repeated calls it again, so ``fn`` must bear that.
    """
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(rows) -> None:
        held = list(rows)
        fn(held)
        seen.add(len(held))

    (df.sortWithinPartitions(*order) if order else df).foreachPartition(run)
    return seen.value
