"""Ordered key-value tables over DataFrames.

A table has one key column in natural or byte order and one value column.  A
stored null does not exist: rows with a null key or value are no entries.
Reads return DataFrames; writes are pure and return a :class:`Change`, the new
table and a result; nothing is stored before a store commits it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions.ranges import KeyRange
from kvloom.operators.deltas import Returned, Result, UpdateMode, changed, delta

Updater = Callable[[Column], Column]
KeyedUpdater = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Change:
    """A new table, and what the write tells about the old one.

    ``written`` is the write alone, if it touches single keys: (key, value) of
    unique keys, null values for deleted ones.  A store appends just that.
    """

    table: KVTable
    result: DataFrame | None = None
    written: DataFrame | None = None


@dataclass(frozen=True)
class KVTable:
    """Entries (key, value) of a DataFrame."""

    df: DataFrame
    key: str = "key"
    value: str = "value"
    mode: UpdateMode = UpdateMode.ALLOW

    # building

    @classmethod
    def from_columns(cls, df: DataFrame, key: Column | str, value: Column | str, mode: UpdateMode = UpdateMode.ALLOW) -> KVTable:
        k, v = (F.col(x) if isinstance(x, str) else x for x in (key, value))
        return cls(df.select(k.alias("key"), v.alias("value")).where(F.col("key").isNotNull() & F.col("value").isNotNull()), mode=mode)

    def _with(self, df: DataFrame) -> KVTable:
        return KVTable(df, self.key, self.value, self.mode)

    def _types(self) -> tuple[T.DataType, T.DataType]:
        return self.df.schema[self.key].dataType, self.df.schema[self.value].dataType

    def entries(self, pairs: Iterable[tuple[Any, Any]] | DataFrame) -> DataFrame:
        """Entries of a write with their position, so that the last of equal keys can win."""
        if isinstance(pairs, DataFrame):
            seq = F.col("seq") if "seq" in pairs.columns else F.monotonically_increasing_id()
            return pairs.select(F.col(self.key), F.col(self.value), seq.alias("seq"))
        k, v = self._types()
        schema = T.StructType([T.StructField(self.key, k), T.StructField(self.value, v), T.StructField("seq", T.LongType())])
        return self.df.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], schema)

    def keys_of(self, keys: Iterable[Any] | DataFrame) -> DataFrame:
        """Keys of a read with their position."""
        if isinstance(keys, DataFrame):
            pos = F.col("pos") if "pos" in keys.columns else F.monotonically_increasing_id()
            return keys.select(F.col(self.key), pos.alias("pos"))
        schema = T.StructType([T.StructField(self.key, self._types()[0]), T.StructField("pos", T.LongType())])
        return self.df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], schema)

    # reads

    def where(self, keys: KeyRange) -> DataFrame:
        return self.df if keys.is_all else self.df.where(keys.predicate(self.key))

    def get(self, key: Any) -> DataFrame:
        """The value of a key; no row if it is absent."""
        return self.where(KeyRange.single(key)).select(self.value)

    def get_multi(self, keys: Iterable[Any] | DataFrame) -> DataFrame:
        """(pos, key, value) for each key in the given order; the value of a missing key is null."""
        return self.keys_of(keys).join(self.df, self.key, "left").select("pos", self.key, self.value).orderBy("pos")

    def scan(self, keys: KeyRange | None = None, reverse: bool = False) -> DataFrame:
        """Entries in key order.  The upper bound stays exclusive in reverse."""
        order = F.col(self.key).desc() if reverse else F.col(self.key).asc()
        return self.where(keys or KeyRange.all()).select(self.key, self.value).orderBy(order)

    def scan_keys(self, keys: KeyRange | None = None, reverse: bool = False) -> DataFrame:
        order = F.col(self.key).desc() if reverse else F.col(self.key).asc()
        return self.where(keys or KeyRange.all()).select(self.key).orderBy(order)

    def _prefix(self, length: int) -> tuple[Column, Column]:
        """The first bytes of the key, and whether it is long enough to have them."""
        return F.substring(self.key, 1, length), F.octet_length(self.key) >= length

    def grouped(self, length: int, keys: KeyRange | None = None) -> DataFrame:
        """(prefix, entries): entries of each byte prefix, both in key order.  A group is one row, so its size is the caller's to know."""
        prefix, enough = self._prefix(length)
        entry = F.struct(F.col(self.key).alias("key"), F.col(self.value).alias("value"))
        return self.where(keys or KeyRange.all()).where(enough).groupBy(prefix.alias("prefix")).agg(F.array_sort(F.collect_list(entry)).alias("entries")).orderBy("prefix")

    def grouped_keys(self, length: int, keys: KeyRange | None = None) -> DataFrame:
        prefix, enough = self._prefix(length)
        return self.where(keys or KeyRange.all()).where(enough).groupBy(prefix.alias("prefix")).agg(F.array_sort(F.collect_list(self.key)).alias("keys")).orderBy("prefix")

    def prefixes(self, length: int, keys: KeyRange | None = None) -> DataFrame:
        """Distinct byte prefixes in order; keys shorter than the prefix are left out."""
        prefix, enough = self._prefix(length)
        return self.where(keys or KeyRange.all()).where(enough).select(prefix.alias("prefix")).distinct().orderBy("prefix")

    def size(self, keys: KeyRange | None = None) -> DataFrame:
        """One row (size)."""
        return self.where(keys or KeyRange.all()).agg(F.count(F.lit(1)).alias("size"))

    def is_empty(self, keys: KeyRange | None = None) -> DataFrame:
        """One row (is_empty); at most one entry is read."""
        return self.where(keys or KeyRange.all()).limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))

    def approximate_size(self) -> DataFrame:
        """One row (size), an estimate of the distinct keys."""
        return self.df.agg(F.approx_count_distinct(self.key).alias("size"))

    def first(self, keys: KeyRange | None = None) -> DataFrame:
        """The entry with the smallest key."""
        return self.scan(keys).limit(1)

    def first_key(self, keys: KeyRange | None = None) -> DataFrame:
        return self.scan_keys(keys).limit(1)

    def contains(self, key: Any) -> DataFrame:
        """One row (contains)."""
        return self.where(KeyRange.single(key)).limit(1).agg((F.count(F.lit(1)) > 0).alias("contains"))

    def partitioned(self, parts: int) -> DataFrame:
        """Entries dealt to ``parts`` consecutive key ranges, each in order."""
        return self.df.repartitionByRange(parts, self.key).sortWithinPartitions(self.key)

    # writes

    def _upserted(self, new: DataFrame) -> KVTable:
        """The table with the entries of ``new`` (unique keys); null values delete."""
        kept = self.df.join(new.select(self.key), self.key, "left_anti")
        return self._with(kept.unionByName(new.where(F.col(self.value).isNotNull()).select(*kept.columns)))

    def _last(self, entries: DataFrame) -> DataFrame:
        """The last entry of each key."""
        one = F.max_by(F.struct(F.col(self.value).alias("v")), "seq")
        return entries.groupBy(self.key).agg(one.alias("last")).select(self.key, F.col("last.v").alias(self.value))

    def _told(self, keys: DataFrame, result: Result) -> DataFrame | None:
        """What the result kind asks about ``keys`` in this table."""
        if result is Result.VOID:
            return None
        met = keys.select(self.key).join(self.df.select(F.col(self.key), F.col(self.value).alias("previous")), self.key, "left")
        return met.select(self.key, "previous") if result is Result.PREVIOUS else met.select(self.key, F.col("previous").isNotNull().alias("existed"))

    def _tombstones(self, keys: DataFrame) -> DataFrame:
        return keys.select(self.key, F.lit(None).cast(self._types()[1]).alias(self.value))

    def put(self, key: Any, value: Any, result: Result = Result.VOID) -> Change:
        return self.put_multi([(key, value)], result)

    def put_multi(self, pairs: Iterable[tuple[Any, Any]] | DataFrame, result: Result = Result.VOID) -> Change:
        """Upsert; of equal keys the last wins; a null value deletes."""
        new = self._last(self.entries(pairs))
        return Change(self._upserted(new), self._told(new, result), new)

    def remove(self, keys: Iterable[Any] | DataFrame, result: Result = Result.VOID) -> Change:
        gone = self.keys_of(keys).select(self.key).distinct()
        return Change(self._with(self.df.join(gone, self.key, "left_anti")), self._told(gone, result), self._tombstones(gone))

    def remove_first(self, keys: KeyRange | None = None) -> Change:
        """Delete the first entry of a range; the result is that entry."""
        one = self.first(keys)
        return Change(self._with(self.df.join(one.select(self.key), self.key, "left_anti")), one, self._tombstones(one))

    def update(self, updater: Updater, keys: Iterable[Any] | DataFrame, returned: Returned = Returned.NOTHING) -> Change:
        """Read-modify-write of the given keys; the updater sees null for a missing key and deletes by giving null."""
        change = self.update_delta(updater, keys)
        if returned is Returned.NOTHING:
            return Change(change.table, None, change.written)
        side = "previous" if returned is Returned.OLD else "current"
        return Change(change.table, change.result.select(self.key, F.col(f"delta.{side}").alias(self.value)), change.written)

    def update_delta(self, updater: Updater, keys: Iterable[Any] | DataFrame) -> Change:
        """As update(); the result is (key, delta(previous, current), changed)."""
        return self.update_keyed(lambda _, old: updater(old), keys)

    def update_keyed(self, updater: KeyedUpdater, keys: Iterable[Any] | DataFrame) -> Change:
        """As update_delta(); the updater sees the key and the old value.  Unchanged entries are not written."""
        self.mode.check()
        wanted = self.keys_of(keys).select(self.key).distinct()
        met = wanted.join(self.df.select(F.col(self.key), F.col(self.value).alias("previous")), self.key, "left")
        after = met.withColumn("current", updater(F.col(self.key), F.col("previous")).cast(self._types()[1]))
        written = after.where(changed(F.col("previous"), F.col("current")))
        result = after.select(self.key, delta(F.col("previous"), F.col("current")).alias("delta"), changed(F.col("previous"), F.col("current")).alias("changed"))
        new = written.select(self.key, F.col("current").alias(self.value))
        return Change(self._upserted(new), result, new)

    def update_all(self, updater: KeyedUpdater, keys: KeyRange | None = None) -> Change:
        """update_keyed() of all entries of a range, without a join."""
        self.mode.check()
        inside = (keys or KeyRange.all()).predicate(self.key)
        after = self.df.where(inside).select(F.col(self.key), F.col(self.value).alias("previous")).withColumn("current", updater(F.col(self.key), F.col("previous")).cast(self._types()[1]))
        result = after.select(self.key, delta(F.col("previous"), F.col("current")).alias("delta"), changed(F.col("previous"), F.col("current")).alias("changed"))
        new = after.where(F.col("current").isNotNull()).select(self.key, F.col("current").alias(self.value))
        return Change(self._with(self.df.where(~inside).select(self.key, self.value).unionByName(new)), result)

    def set_range(self, keys: KeyRange, pairs: Iterable[tuple[Any, Any]] | DataFrame) -> Change:
        """Replace all entries of a range; an entry outside of it is an error; the result is the old entries."""
        new = self._last(self.entries(pairs)).where(F.col(self.value).isNotNull())
        outside = F.raise_error(F.concat(F.lit("key outside the range: "), F.col(self.key).cast("string")))
        guarded = new.withColumn(self.key, F.when(keys.predicate(self.key), F.col(self.key)).otherwise(outside.cast(self._types()[0])))
        kept = self.df.where(~keys.predicate(self.key)).select(self.key, self.value)
        return Change(self._with(kept.unionByName(guarded.select(self.key, self.value))), self.where(keys))

    def replace_range(self, keys: KeyRange, fn: Callable[[Column, Column], tuple[Column, Column]], can_keys_change: bool = True) -> Change:
        """Map the entries of a range.  With ``can_keys_change`` false the key is kept.  Equal new keys: the greatest old key wins."""
        new_key, new_value = fn(F.col(self.key), F.col(self.value))
        made = self.where(keys).select((new_key if can_keys_change else F.col(self.key)).alias("k"), new_value.alias("v"), F.col(self.key).alias("old"))
        if can_keys_change:
            made = made.groupBy("k").agg(F.max_by(F.struct("v"), "old").alias("one")).select("k", F.col("one.v").alias("v"))
        new = made.select(F.col("k").alias(self.key), F.col("v").alias(self.value)).where(F.col(self.value).isNotNull())
        kept = self.df.where(~keys.predicate(self.key)).select(self.key, self.value)
        if can_keys_change:
            kept = kept.join(new.select(self.key), self.key, "left_anti")
        return Change(self._with(kept.unionByName(new)), self.where(keys))

    def clear(self, keys: KeyRange | None = None) -> Change:
        """Delete a range; the result is what was in it."""
        keys = keys or KeyRange.all()
        left = self.df.limit(0) if keys.is_all else self.df.where(~keys.predicate(self.key))
        return Change(self._with(left), self.where(keys))

    def ingest(self, run: DataFrame, replace_existing: bool = True) -> Change:
        """Bulk load of unique keys: new entries win, or go behind the existing ones."""
        new = run.select(self.key, self.value)
        if replace_existing:
            return Change(self._upserted(new), None, new)
        behind = new.join(self.df, self.key, "left_anti")
        return Change(self._with(self.df.select(self.key, self.value).unionByName(behind)), None, behind)


def deltas_between(old: KVTable, new: KVTable) -> DataFrame:
    """(key, previous, current) of every key whose value differs between two versions."""
    a = old.df.select(F.col(old.key).alias("key"), F.col(old.value).alias("previous"))
    b = new.df.select(F.col(new.key).alias("key"), F.col(new.value).alias("current"))
    return a.join(b, "key", "full_outer").where(changed(F.col("previous"), F.col("current")))
