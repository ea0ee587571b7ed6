"""Kinds of index fields: how a column is typed, searched and given back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.plans.compiler import Index, text_index


@dataclass(frozen=True)
class FieldKind:
    """``spark_type`` of the column; whether it is analysed, can be asked for in queries, and is given back with hits."""

    spark_type: str
    analysed: bool = False
    searched: bool = True
    stored: bool = False


#: The public names of the kinds.
KINDS = {
    "StringField": FieldKind("string"),
    "StringFieldStored": FieldKind("string", stored=True),
    "IntPoint": FieldKind("int"),
    "LongPoint": FieldKind("bigint"),
    "FloatPoint": FieldKind("float"),
    "DoublePoint": FieldKind("double"),
    "IntPointND": FieldKind("array<int>"),
    "LongPointND": FieldKind("array<bigint>"),
    "FloatPointND": FieldKind("array<float>"),
    "DoublePointND": FieldKind("array<double>"),
    "LongStoredField": FieldKind("bigint", searched=False, stored=True),
    "BytesStoredField": FieldKind("binary", searched=False, stored=True),
    "NumericDocValuesField": FieldKind("bigint"),
    "SortedNumericDocValuesField": FieldKind("bigint"),
    "TextField": FieldKind("string", analysed=True),
    "TextFieldStored": FieldKind("string", analysed=True, stored=True),
}


def index_of(df: DataFrame, key: str, kinds: dict[str, str]) -> Index:
    """An index over the columns of ``kinds`` (column: kind); other columns are left out, and so are those that are only stored."""
    unknown = sorted(set(kinds.values()) - set(KINDS))
    if unknown:
        raise ValueError(f"unknown kinds of fields: {', '.join(unknown)}")
    columns = [F.col(c).cast(KINDS[k].spark_type).alias(c) for c, k in kinds.items() if KINDS[k].searched and c != key]
    return text_index(df.select(key, *columns), key, *[c for c, k in kinds.items() if KINDS[k].analysed])


def given_back(hits: DataFrame, df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """The hits (key, ...) with the stored fields of their documents."""
    stored = [F.col(c).cast(KINDS[k].spark_type).alias(c) for c, k in kinds.items() if KINDS[k].stored and c != key]
    return hits.join(df.select(key, *stored), key, "left")
