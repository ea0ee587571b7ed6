"""Counts and sizes seen while a query runs, without another pass, and times of operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df``, and the observation that holds ``rows`` and the measures once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]), seen


class Timers:
    """Seconds of operations by name, as the driver sees them."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, float]] = []

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seen.append((name, time.perf_counter() - start))

    def report(self, spark: SparkSession) -> DataFrame:
        """(name, times, total, p20, p50, p95)."""
        rows = spark.createDataFrame(self.seen, "name string, seconds double")
        points = F.percentile("seconds", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.95)))
        report = rows.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.sum("seconds").alias("total"), points.alias("p"))
        return report.select("name", "times", "total", *[F.col("p")[i].alias(n) for i, n in enumerate(("p20", "p50", "p95"))])
