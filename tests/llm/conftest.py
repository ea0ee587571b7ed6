"""Fixtures of the tests of training-data operators."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) tuples, with extra columns of clashing names."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r))), 1, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, kept int, size string")

    return make
