"""Collections over typed key columns.

A :class:`Node` addresses a value in a table with key columns ``k1 .. kn`` and
a value column: the whole table is a map of maps, ``at(key)`` goes one level
down, and with all keys given it is an entry.  Hashed maps and sets are the
same with keys of any length and without a value; a named cell is an entry of a
one-level table.  Reads are DataFrames; writes go through the node's
:class:`Holder`, which keeps the current table or commits it to a store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions.ranges import conjunction
from kvloom.operators.deltas import Returned, UpdateMode, changed, delta


@dataclass(frozen=True)
class KeyLevel:
    """One level of keys: its type, and for text or bytes its exact width if it is fixed."""

    name: str
    type: T.DataType
    width: int | None = None

    def check(self, key: Any) -> Any:
        if key is None:
            raise ValueError(f"{self.name}: a key is needed")
        size = len(key.encode()) if isinstance(key, str) else len(key) if isinstance(key, bytes) else None
        if self.width is not None and size != self.width:
            raise ValueError(f"{self.name}: {size} bytes, not {self.width}")
        return key


@dataclass(frozen=True)
class Shape:
    """The levels of keys and the value; a set has no value column of its own."""

    levels: tuple[KeyLevel, ...]
    value: T.DataType | None
    value_name: str = "value"

    @property
    def names(self) -> list[str]:
        return [level.name for level in self.levels]

    def schema(self) -> T.StructType:
        fields = [T.StructField(level.name, level.type, False) for level in self.levels]
        return T.StructType([*fields, T.StructField(self.value_name, self.value or T.BooleanType())])


class Holder:
    """The current table of a collection; subclasses make it durable."""

    def __init__(self, df: DataFrame, mode: UpdateMode = UpdateMode.ALLOW):
        self.df, self.mode = df, mode

    def read(self, snapshot: Any = None) -> DataFrame:
        """The table; a snapshot is a DataFrame handle taken earlier."""
        return self.df if snapshot is None else snapshot

    def snapshot(self) -> DataFrame:
        return self.df

    def change(self, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the table by ``fn`` of it."""
        self.df = fn(self.df)

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Write the rows that ``fn`` makes of the table: unique keys with a value, or null to delete them.

        The keys come from the caller, so the rows fit the driver; they are made
        at once, so that the table's plan doesn't hold itself twice.
        """
        rows = fn(self.df)
        self.df = written_into(self.df, self.df.sparkSession.createDataFrame(rows.collect(), rows.schema))


def written_into(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` after the rows are written; the last column is the value, null for deleted keys."""
    *keys, value = df.columns
    return df.join(rows.select(*keys), keys, "left_anti").unionByName(rows.where(F.col(value).isNotNull()).select(*df.columns))


@dataclass(frozen=True)
class Node:
    """The value at a path of keys: the whole collection, a map inside, or an entry."""

    holder: Holder
    shape: Shape
    path: tuple = field(default=())

    # addressing

    @property
    def is_entry(self) -> bool:
        return len(self.path) == len(self.shape.levels)

    @property
    def _value(self) -> str:
        return self.shape.value_name

    @property
    def _rest(self) -> list[str]:
        return self.shape.names[len(self.path) :]

    def at(self, key: Any) -> Node:
        if self.is_entry:
            raise ValueError("an entry has no children")
        return Node(self.holder, self.shape, (*self.path, self.shape.levels[len(self.path)].check(key)))

    def _here(self) -> Column:
        return conjunction([F.col(n) == F.lit(k) for n, k in zip(self.shape.names, self.path, strict=False)])

    def rows(self, snapshot: Any = None) -> DataFrame:
        """All rows below this node, with every key column."""
        df = self.holder.read(snapshot)
        return df.where(self._here()) if self.path else df

    # reads

    def get(self, snapshot: Any = None) -> DataFrame:
        """The value of an entry; of a one-level map, one row with the map, or no row if it is empty."""
        if self.is_entry:
            return self.rows(snapshot).select(self._value)
        entry = F.struct(*[F.col(n) for n in self._rest], F.col(self._value))
        if len(self._rest) == 1:
            collected = F.map_from_entries(F.array_sort(F.collect_list(entry)))
        else:
            collected = F.array_sort(F.collect_list(entry))
        return self.rows(snapshot).agg(F.count(F.lit(1)).alias("n"), collected.alias(self._value)).where("n > 0").select(self._value)

    def get_or_default(self, default: Any, snapshot: Any = None) -> DataFrame:
        """One row: the value or the default."""
        found = self.get(snapshot).select(F.struct(self._value).alias("one"))
        return found.agg(F.coalesce(F.max("one")[self._value], F.lit(default)).alias(self._value))

    def contains(self, key: Any, snapshot: Any = None) -> DataFrame:
        return self.at(key).rows(snapshot).limit(1).agg((F.count(F.lit(1)) > 0).alias("contains"))

    def leaves(self, snapshot: Any = None, since: Any = None, merge: Callable[..., Column] | None = None) -> DataFrame:
        """All entries below with their remaining keys, in key order.

        ``since`` is the key of the next level to go on from, as a reader that
        stopped has saved it; with ``merge`` the rows are (that key, merged), made
        of all keys and the value.
        """
        df = self.rows(snapshot)
        if since is not None:
            df = df.where(F.col(self._rest[0]) >= F.lit(since))
        ordered = df.select(*self._rest, self._value).orderBy(*self._rest)
        if merge is None:
            return ordered
        return ordered.select(self._rest[0], merge(*[F.col(c) for c in (*self._rest, self._value)]).alias("merged"))

    def stages(self, snapshot: Any = None) -> Iterator[StageEntry]:
        """The children of the next level, in key order, one at a time."""
        for row in self.keys(snapshot).toLocalIterator():
            yield StageEntry(row[0], self.at(row[0]))

    def entries(self, snapshot: Any = None, low: Any = None, high: Any = None, reverse: bool = False) -> DataFrame:
        """Entries below in order of the next key, within [low, high)."""
        df, name = self.rows(snapshot), self._rest[0]
        bounds = [F.col(name) >= F.lit(low)] * (low is not None) + [F.col(name) < F.lit(high)] * (high is not None)
        order = [F.col(n).desc() if reverse else F.col(n).asc() for n in self._rest]
        return df.where(conjunction(bounds)).select(*self._rest, self._value).orderBy(*order)

    def keys(self, snapshot: Any = None) -> DataFrame:
        """The distinct keys of the next level in order."""
        one = self.rows(snapshot).select(self._rest[0])
        return (one if len(self._rest) == 1 else one.distinct()).orderBy(self._rest[0])

    def values(self, snapshot: Any = None) -> DataFrame:
        return self.leaves(snapshot).select(self._value)

    def leaves_count(self, snapshot: Any = None) -> DataFrame:
        return self.rows(snapshot).agg(F.count(F.lit(1)).alias("leaves"))

    def is_empty(self, snapshot: Any = None) -> DataFrame:
        return self.rows(snapshot).limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))

    def get_multi(self, keys: list[Any], snapshot: Any = None) -> DataFrame:
        """(pos, key, value) for keys of the last level, in the given order."""
        level = self.shape.levels[-1]
        asked = self._frame([(i, level.check(k)) for i, k in enumerate(keys)], [T.StructField("pos", T.IntegerType()), T.StructField(level.name, level.type)])
        return asked.join(self.rows(snapshot).select(level.name, self._value), level.name, "left").select("pos", level.name, self._value).orderBy("pos")

    def _frame(self, rows: list[tuple], fields: list[T.StructField]) -> DataFrame:
        return self.holder.read().sparkSession.createDataFrame(rows, T.StructType(fields))

    # writes; each returns what it was asked for as a DataFrame of the state before the write

    def _entry_frame(self, value: Any) -> DataFrame:
        return self._frame([(*self.path, value)], list(self.shape.schema().fields))

    def _pairs_frame(self, pairs: dict | list, deleted: bool = False) -> DataFrame:
        """Rows for pairs of (remaining keys, value); the last of equal keys wins; with ``deleted``, those of null values too."""
        last = {}
        for key, value in pairs.items() if isinstance(pairs, dict) else pairs:
            parts = key if isinstance(key, tuple) else (key,)
            last[tuple(level.check(k) for level, k in zip(self.shape.levels[len(self.path) :], parts, strict=True))] = value
        return self._frame([(*self.path, *k, v) for k, v in last.items() if deleted or v is not None], list(self.shape.schema().fields))

    def _replace(self, new: DataFrame | None) -> None:
        """Everything below this node becomes ``new``."""
        here = self._here()
        self.holder.change(lambda df: df.where(~here) if new is None else df.where(~here).unionByName(new))

    def set(self, value: Any) -> None:
        """Write the entry or replace the whole map; null deletes."""
        if self.is_entry:
            self.holder.apply(lambda _: self._entry_frame(value))
        else:
            self._replace(self._pairs_frame(value or {}))

    def set_and_get_previous(self, value: Any) -> DataFrame:
        before = self.get()
        self.set(value)
        return before

    def set_and_get_changed(self, value: Any) -> DataFrame:
        """One row (changed)."""
        if self.is_entry:
            before = self.get().agg(F.max(F.struct(self._value)).alias("one"))
            asked = before.select(changed(F.col(f"one.{self._value}"), F.lit(value).cast(self.shape.value or T.BooleanType())).alias("changed"))
        else:
            old, new = self.rows(), self._pairs_frame(value or {})
            asked = old.exceptAll(new).unionByName(new.exceptAll(old)).limit(1).agg((F.count(F.lit(1)) > 0).alias("changed"))
        self.set(value)
        return asked

    def clear(self) -> None:
        if self.is_entry:
            self.set(None)
        else:
            self._replace(None)

    def clear_and_get_previous(self) -> DataFrame:
        before = self.get()
        self.clear()
        return before

    def clear_and_get_status(self) -> DataFrame:
        """One row (existed)."""
        before = self.rows().limit(1).agg((F.count(F.lit(1)) > 0).alias("existed"))
        self.clear()
        return before

    def update(self, updater: Callable[[Column], Column], returned: Returned = Returned.NOTHING) -> DataFrame | None:
        """Read-modify-write of an entry."""
        both = self.update_and_get_delta(updater)
        if returned is Returned.NOTHING:
            return None
        side = "previous" if returned is Returned.OLD else "current"
        return both.select(F.col(f"delta.{side}").alias(self._value))

    def update_and_get_delta(self, updater: Callable[[Column], Column]) -> DataFrame:
        """One row (delta, changed).  Of a whole map only where updates are unsafe: the map is not locked meanwhile."""
        self.holder.mode.check()
        if not self.is_entry:
            if self.holder.mode is not UpdateMode.ALLOW_UNSAFE:
                raise PermissionError("a whole map is updated in unsafe mode only")
            return self._update_map(updater)
        type_, told = self.shape.value or T.BooleanType(), []

        def write(df: DataFrame) -> DataFrame:
            before = df.where(self._here()).agg(F.max(F.struct(self._value)).alias("one")).select(F.col(f"one.{self._value}").alias("previous"))
            after = before.withColumn("current", updater(F.col("previous")).cast(type_))
            told[:] = [after.select(delta(F.col("previous"), F.col("current")).alias("delta"), changed(F.col("previous"), F.col("current")).alias("changed"))]
            fixed = [F.lit(k).cast(level.type).alias(level.name) for level, k in zip(self.shape.levels, self.path, strict=True)]
            return after.select(*fixed, F.col("current").alias(self._value))

        self.holder.apply(write)
        return told[0]

    def _update_map(self, updater: Callable[[Column], Column]) -> DataFrame:
        before = self.get().agg(F.max(F.struct(F.map_entries(self._value).alias("e"))).alias("one"))
        both = before.select(F.map_from_entries("one.e").alias("previous"))
        both = both.withColumn("current", updater(F.col("previous")))
        keys = [F.lit(k).cast(level.type).alias(level.name) for level, k in zip(self.shape.levels, self.path, strict=False)]
        self._replace(both.select(*keys, F.explode("current").alias(self._rest[0], self._value)).where(F.col(self._value).isNotNull()))
        flat = lambda c: F.array_sort(F.map_entries(c))
        return both.select(F.struct("previous", "current").alias("delta"), changed(flat("previous"), flat("current")).alias("changed"))

    # children of the last level

    def put(self, key: Any, value: Any) -> None:
        self.at(key).set(value)

    def put_and_get_previous(self, key: Any, value: Any) -> DataFrame:
        return self.at(key).set_and_get_previous(value)

    def put_and_get_changed(self, key: Any, value: Any) -> DataFrame:
        return self.at(key).set_and_get_changed(value)

    def remove(self, key: Any) -> None:
        self.at(key).clear()

    def remove_and_get_previous(self, key: Any) -> DataFrame:
        return self.at(key).clear_and_get_previous()

    def remove_and_get_status(self, key: Any) -> DataFrame:
        return self.at(key).clear_and_get_status()

    def put_multi(self, pairs: dict | list) -> None:
        """Write children of the levels below; the last of equal keys wins, null deletes."""
        rows = self._pairs_frame(pairs, deleted=True)
        self.holder.apply(lambda _: rows)

    def update_multi(self, keys: list[Any], updater: Callable[[Column, Column], Column]) -> DataFrame:
        """Keyed update of children of the last level; one row a key in order: (pos, key, changed)."""
        self.holder.mode.check()
        level, type_, told = self.shape.levels[-1], self.shape.value or T.BooleanType(), []
        asked = self._frame([(i, level.check(k)) for i, k in enumerate(keys)], [T.StructField("pos", T.IntegerType()), T.StructField(level.name, level.type)])
        fixed = [F.lit(k).cast(at.type).alias(at.name) for at, k in zip(self.shape.levels, self.path, strict=False)]

        def write(df: DataFrame) -> DataFrame:
            here = df.where(self._here()) if self.path else df
            met = asked.join(here.select(level.name, F.col(self._value).alias("previous")), level.name, "left")
            after = met.withColumn("current", updater(F.col(level.name), F.col("previous")).cast(type_))
            told[:] = [after.select("pos", level.name, changed(F.col("previous"), F.col("current")).alias("changed"))]
            return after.select(*fixed, level.name, F.col("current").alias(self._value)).dropDuplicates(self.shape.names)

        self.holder.apply(write)
        return told[0].orderBy("pos")

    def set_all(self, pairs: dict | list) -> None:
        """Replace everything below."""
        self._replace(self._pairs_frame(pairs))

    def set_all_and_get_previous(self, pairs: dict | list) -> DataFrame:
        before = self.leaves()
        self.set_all(pairs)
        return before

    def replace_all(self, fn: Callable[[Column, Column], tuple[Column, Column]], can_keys_change: bool = True) -> None:
        """Map all entries below by the last key and the value; of equal new keys the greatest old key wins."""
        name = self.shape.levels[-1].name
        key, value = fn(F.col(name), F.col(self._value))
        fixed = self.shape.names[:-1]
        made = self.rows().select(*fixed, (key if can_keys_change else F.col(name)).alias("new"), value.alias("v"), F.col(name).alias("old"))
        one = made.groupBy(*fixed, "new").agg(F.max_by(F.struct("v"), "old").alias("one"))
        self._replace(one.select(*fixed, F.col("new").alias(name), F.col("one.v").alias(self._value)).where(F.col(self._value).isNotNull()))

    # sets

    def key_set(self, snapshot: Any = None) -> DataFrame:
        return self.keys(snapshot)

    def set_key_set(self, keys: set | list) -> DataFrame:
        """Replace the members; the result is the members before."""
        before = self.keys()
        self.set_all([(k, True) for k in keys])
        return before

    def clear_key_set(self) -> DataFrame:
        before = self.keys()
        self.clear()
        return before

    # views

    def mapped(self, forward: Callable[[Column], Column], back: Callable[[Column], Column]) -> Mapped:
        return Mapped(self, forward, back)


@dataclass(frozen=True)
class StageEntry:
    """A key and the node it leads to."""

    key: Any
    stage: Node


@dataclass(frozen=True)
class Mapped:
    """An entry seen through a bijection."""

    node: Node
    forward: Callable[[Column], Column]
    back: Callable[[Column], Column]

    def get(self, snapshot: Any = None) -> DataFrame:
        name = self.node.shape.value_name
        return self.node.get(snapshot).select(self.forward(F.col(name)).alias(name))

    def set(self, value: Any) -> DataFrame:
        return self.node.update_and_get_delta(lambda _: self.back(F.lit(value)))

    def update(self, updater: Callable[[Column], Column], returned: Returned = Returned.NOTHING) -> DataFrame | None:
        out = self.node.update(lambda old: self.back(updater(self.forward(old))), returned)
        name = self.node.shape.value_name
        return None if out is None else out.select(self.forward(F.col(name)).alias(name))


def _empty(spark, shape: Shape) -> DataFrame:
    return spark.createDataFrame([], shape.schema())


def flat_map(spark, key: KeyLevel, value: T.DataType, mode: UpdateMode = UpdateMode.ALLOW, df: DataFrame | None = None) -> Node:
    shape = Shape((key,), value)
    return Node(Holder(df if df is not None else _empty(spark, shape), mode), shape)


def nested_map(spark, keys: list[KeyLevel], value: T.DataType, mode: UpdateMode = UpdateMode.ALLOW, df: DataFrame | None = None) -> Node:
    shape = Shape(tuple(keys), value)
    return Node(Holder(df if df is not None else _empty(spark, shape), mode), shape)


def key_set(spark, key: KeyLevel, mode: UpdateMode = UpdateMode.ALLOW, df: DataFrame | None = None) -> Node:
    shape = Shape((key,), None)
    held = df.select(F.col(key.name), F.lit(True).alias("value")).distinct() if df is not None else _empty(spark, shape)
    return Node(Holder(held, mode), shape)


def hashed(df: DataFrame, key: str, hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The table with the caller's hash of its variable-length key, for partitioning."""
    return df.withColumn("hash", hash_fn(F.col(key)))


def buckets(df: DataFrame, key: str, value: str) -> DataFrame:
    """(hash, entries): the physical view of a hashed map.  A bucket is one row, so its size is the hash's to keep small."""
    return df.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))).alias("entries"))


@dataclass(frozen=True)
class HashedMap:
    """A map with keys of any length, its entries dealt to buckets by a hash: rows (hash, key, value).

    A write touches the rows of its keys; reads of a key name its bucket, so that
    they are pruned by hash.
    """

    node: Node
    hash_fn: Callable[[Column], Column]

    @property
    def _key(self) -> KeyLevel:
        return self.node.shape.levels[1]

    @property
    def _value(self) -> str:
        return self.node.shape.value_name

    def _hash(self, key: Any) -> Any:
        spark = self.node.holder.read().sparkSession
        return spark.range(1).select(self.hash_fn(F.lit(self._key.check(key)).cast(self._key.type))).first()[0]

    def at(self, key: Any) -> Node:
        """The entry, inside its bucket."""
        return self.node.at(self._hash(key)).at(key)

    def bucket(self, hash_: Any) -> Node:
        """The map of the entries with this hash."""
        return self.node.at(hash_)

    def buckets(self, snapshot: Any = None) -> DataFrame:
        """(hash, entries)."""
        return buckets(self.node.rows(snapshot), self._key.name, self._value)

    def entries(self, snapshot: Any = None) -> DataFrame:
        """(key, value); the order is that of the hashes."""
        return self.node.leaves(snapshot).select(self._key.name, self._value)

    def keys(self, snapshot: Any = None) -> DataFrame:
        return self.entries(snapshot).select(self._key.name)

    def get(self, key: Any, snapshot: Any = None) -> DataFrame:
        return self.at(key).get(snapshot)

    def contains(self, key: Any, snapshot: Any = None) -> DataFrame:
        return self.at(key).rows(snapshot).limit(1).agg((F.count(F.lit(1)) > 0).alias("contains"))

    def count(self, snapshot: Any = None) -> DataFrame:
        return self.node.leaves_count(snapshot)

    def _hashed(self, pairs: dict | list, deleted: bool) -> DataFrame:
        last = {self._key.check(k): v for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)}
        fields = list(self.node.shape.schema().fields)[1:]
        rows = self.node._frame([(k, v) for k, v in last.items() if deleted or v is not None], fields)
        return hashed(rows, self._key.name, self.hash_fn).select("hash", *[f.name for f in fields])

    def put_multi(self, pairs: dict | list) -> None:
        """The last of equal keys wins, null deletes."""
        rows = self._hashed(pairs, True)
        self.node.holder.apply(lambda _: rows)

    def put(self, key: Any, value: Any) -> None:
        self.put_multi({key: value})

    def remove(self, key: Any) -> None:
        self.put(key, None)

    def update(self, keys: list[Any], updater: Callable[[Column, Column], Column]) -> DataFrame:
        """Keyed update; (key, previous, current, changed)."""
        self.node.holder.mode.check()
        asked, told, name = self._hashed(dict.fromkeys(keys), True).select("hash", self._key.name), [], self._key.name

        def write(df: DataFrame) -> DataFrame:
            met = asked.join(df.withColumnRenamed(self._value, "previous"), ["hash", name], "left")
            after = met.withColumn("current", updater(F.col(name), F.col("previous")).cast(self.node.shape.value or T.BooleanType()))
            told[:] = [after.select(name, "previous", "current", changed(F.col("previous"), F.col("current")).alias("changed"))]
            return after.select("hash", name, F.col("current").alias(self._value))

        self.node.holder.apply(write)
        return told[0]

    def set_all(self, pairs: dict | list) -> None:
        """Replace all entries."""
        self.node._replace(self._hashed(pairs, False))

    def clear(self) -> None:
        self.node.clear()


@dataclass(frozen=True)
class HashedSet:
    """A set with members of any length, dealt to buckets by a hash."""

    map: HashedMap

    def add(self, *members: Any) -> None:
        self.map.put_multi(dict.fromkeys(members, True))

    def discard(self, *members: Any) -> None:
        self.map.put_multi(dict.fromkeys(members))

    def contains(self, member: Any, snapshot: Any = None) -> DataFrame:
        return self.map.contains(member, snapshot)

    def members(self, snapshot: Any = None) -> DataFrame:
        return self.map.keys(snapshot)

    def set_members(self, members: set | list) -> DataFrame:
        """Replace the members; the result is the members before."""
        before = self.members()
        self.map.set_all(dict.fromkeys(members, True))
        return before

    def count(self, snapshot: Any = None) -> DataFrame:
        return self.map.count(snapshot)


def hashed_shape(key: KeyLevel, value: T.DataType | None, hash_type: T.DataType) -> Shape:
    return Shape((KeyLevel("hash", hash_type), key), value)


def hashed_map(spark, key: KeyLevel, value: T.DataType, hash_fn: Callable[[Column], Column] = F.xxhash64, hash_type: T.DataType | None = None, mode: UpdateMode = UpdateMode.ALLOW, df: DataFrame | None = None) -> HashedMap:
    """``df`` has the key and ``value``, without the hash."""
    shape = hashed_shape(key, value, hash_type or T.LongType())
    held = _empty(spark, shape) if df is None else hashed(df, key.name, hash_fn).select("hash", key.name, shape.value_name)
    return HashedMap(Node(Holder(held, mode), shape), hash_fn)


def hashed_set(spark, key: KeyLevel, hash_fn: Callable[[Column], Column] = F.xxhash64, hash_type: T.DataType | None = None, mode: UpdateMode = UpdateMode.ALLOW, df: DataFrame | None = None) -> HashedSet:
    held = None if df is None else df.select(key.name).distinct().withColumn("value", F.lit(True))
    return HashedSet(hashed_map(spark, key, T.BooleanType(), hash_fn, hash_type, mode, held))


@dataclass(frozen=True)
class Cell:
    """A named value with a default, written when it is absent."""

    node: Node
    default: Any

    @classmethod
    def open(cls, cells: Node, name: str, default: Any = None) -> Cell:
        cell = cls(cells.at(name), default)
        if default is not None:
            cell.node.update_and_get_delta(lambda old: F.coalesce(old, F.lit(default)))
        return cell

    def get(self, snapshot: Any = None) -> DataFrame:
        return self.node.get_or_default(self.default, snapshot)

    def set(self, value: Any) -> None:
        self.node.set(value)

    def update(self, updater: Callable[[Column], Column], returned: Returned = Returned.NOTHING) -> DataFrame | None:
        return self.node.update(updater, returned)


def wrapping_add(a: Column, b: Column) -> Column:
    """64-bit addition that wraps around, as ANSI mode would raise."""
    total = F.coalesce(a, F.lit(0)).cast("decimal(20,0)") + F.coalesce(b, F.lit(0)).cast("decimal(20,0)")
    span, half = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    low, high = F.lit("-9223372036854775808").cast("decimal(20,0)"), half
    wrapped = F.when(total >= high, total - span).when(total < low, total + span).otherwise(total)
    return wrapped.cast("bigint")


class LongCounter(Cell):
    """A 64-bit cell with atomic adds; a missing cell is 0."""

    kind = "bigint"

    def _plus(self, n: int) -> Callable[[Column], Column]:
        return lambda old: wrapping_add(old, F.lit(n))

    def add_and_get(self, n: int) -> DataFrame:
        return self.node.update(self._plus(n), Returned.NEW)

    def get_and_add(self, n: int) -> DataFrame:
        out = self.node.update(self._plus(n), Returned.OLD)
        return out.select(F.coalesce(self.node.shape.value_name, F.lit(0)).cast(self.kind).alias(self.node.shape.value_name))

    def increment_and_get(self) -> DataFrame:
        return self.add_and_get(1)

    def get_and_increment(self) -> DataFrame:
        return self.get_and_add(1)

    def decrement_and_get(self) -> DataFrame:
        return self.add_and_get(-1)

    def get_and_decrement(self) -> DataFrame:
        return self.get_and_add(-1)


class IntCounter(LongCounter):
    """A 32-bit cell; adds wrap around."""

    kind = "int"

    def _plus(self, n: int) -> Callable[[Column], Column]:
        def add(old: Column) -> Column:
            low = F.pmod(F.coalesce(old, F.lit(0)).cast("bigint") + F.lit(n), F.lit(1 << 32))
            return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")

        return add


def add_all(counters: DataFrame, additions: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Counters after a batch of (key, value) additions; one shuffle of partial sums."""
    summed = additions.groupBy(key).agg(F.sum(value).alias("added"))
    met = counters.join(summed, key, "full_outer")
    return met.select(key, wrapping_add(F.col(value), F.col("added")).alias(value))
