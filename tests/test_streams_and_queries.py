"""Dataflow operators, and every registered query against its SQL."""

from __future__ import annotations

import subprocess
import sys
from itertools import groupby
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from kvloom import queries
from kvloom.operators import streams
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        found.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return found


def plain(x):
    return repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    want = con.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_runs_cross_partitions(spark):
    keys = "aaaabbacccccccccccccccccccccccccccdd"
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(100, None), (101, None)], "i int, k string")
    got = [r.run for r in streams.consecutive(df, "k", ["i"]).orderBy("i").collect()]
    want = [i for i, (_, g) in enumerate(groupby([*keys, None, None])) for _ in g]
    assert got == want
    by = streams.consecutive(df.withColumn("g", F.col("i") % 2), "k", ["i"], ["g"]).where("g = 0").orderBy("i").collect()
    assert [r.run for r in by] == [i for i, (_, g) in enumerate(groupby([r.k for r in by])) for _ in g]


def test_small_streams(spark):
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate([1, 2, 9, 1])], "i int, g string, v int")
    assert [r.i for r in streams.take_while(df, F.col("v") < 5, ["i"], ["g"]).collect()] == [0, 1]
    assert [r.i for r in streams.take_until(df, F.col("v") >= 5, ["i"], ["g"]).collect()] == [0, 1, 2]
    assert streams.fold(df, "v", F.lit(0), lambda a, b: a + b, ["g"]).first().folded == 13
    assert streams.indexed(df.limit(0), ["i"]).count() == 0
    assert [r.i for r in streams.shuffled(df, "i", "s").collect()] == [r.i for r in streams.shuffled(df, "i", "s").collect()]
    assert df.where(streams.every([])).count() == 4 and df.where(streams.either([])).count() == 0
    assert df.where(streams.either([F.col("v") == 2, F.col("v") == 9])).count() == 2
    assert df.select(streams.repeated(F.col("v"), 2).alias("r")).first().r == [1, 1]
    assert [streams.backoff(t, unit=0.5) for t in (0, 3, 20)] == [1, 8, 2000]


def test_entry_works_without_the_training_data_package(tmp_path):
    """With the subpackage and the pipeline gone, the registry still imports."""
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.parts and p.name != "corpus_pipeline.py":
            (tmp_path / p.relative_to(ROOT)).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p.relative_to(ROOT)).write_text(p.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL)), "False"]


def test_observed_rows(spark):
    from kvloom.operators.metrics import observed

    df, seen = observed(spark.range(7), "seen", most=F.max("id"))
    assert df.count() == 7 and seen.get == {"rows": 7, "most": 6}
