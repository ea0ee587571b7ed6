"""Databases of named columns with immutable versions.

A disk database is a folder: ``data/<column>/<id>`` holds Parquet written once,
``versions/<n>.json`` names the runs that each column of version n consists of.
The first run is the base; later ones are deltas, written keys with their
values, null for deleted keys.  A write of single keys appends a delta; readers
merge the runs by key, the last one wins.  ``MOST_RUNS`` deltas are merged into
one, and with the base once they hold ``REWRITE`` of its rows.

A commit writes data first and then creates the next version file, which fails
if another writer has made it: compare and swap.  Readers pin a version and are
never disturbed.  A memory database keeps the same versions as DataFrames.

File semantics: creating the version file must be atomic and exclusive.  Local
files use O_EXCL; other file systems use Hadoop's create without overwrite,
which HDFS makes exclusive and some object stores do not.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions.ranges import FileRange, KeyRange
from kvloom.operators.deltas import UpdateMode
from kvloom.operators.stages import Cell, Holder, IntCounter, KeyLevel, LongCounter, Node, Shape, written_into
from kvloom.operators.streams import backoff, indexed
from kvloom.operators.table import KVTable
from kvloom.sources.scratch import pinned

BINARY_ENTRY = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])


MOST_RUNS = 8
REWRITE = 0.25
MOST_SENT = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Delta:
    """Rows to write into a column: unique keys with their values, null (the last column) for deleted ones."""

    rows: DataFrame


class Isolation(Enum):
    """How a write meets other writers: it runs again after a conflict; it holds a lock; or the last one wins."""

    OPTIMISTIC = "optimistic"
    PESSIMISTIC = "pessimistic"
    PLAIN = "plain"


@dataclass(frozen=True)
class MemorySettings:
    pass


@dataclass(frozen=True)
class LocalSettings:
    path: str
    read_only: bool = False
    compression: str = "zstd"
    bloom_keys: bool = False


@dataclass(frozen=True)
class MultiSettings:
    """Settings by database name, and those of all other names."""

    databases: dict[str, Any]
    default: Any


def map_column(name: str) -> str:
    return f"hash_map_{name}"


def set_column(name: str) -> str:
    return f"hash_set_{name}"


def special_column(name: str) -> str:
    return name


@dataclass(frozen=True)
class Snapshot:
    id: str
    version: int


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        scheme = self._fs.getScheme()
        self._local = self.root.removeprefix("file://").removeprefix("file:") if scheme == "file" else None

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def names(self, *parts: str) -> list[str]:
        path = self._path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.at(*parts)))

    def size(self, *parts: str) -> int:
        path = self._path(self.at(*parts))
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.at(*parts)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> None:
        """Write a new file; Conflict if it exists."""
        if self._local is not None:
            target = "/".join([self._local, *parts])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            whole = f"{target}.{uuid.uuid4().hex}.new"
            with open(whole, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(whole, target)  # exclusive, and never seen half written
            except FileExistsError:
                raise Conflict(target) from None
            finally:
                os.unlink(whole)
            return
        try:
            stream = self._fs.create(self._path(self.at(*parts)), False)
        except Exception as error:  # noqa: BLE001  the file system's own kinds of "exists"
            raise Conflict(self.at(*parts)) from error
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)


def _sums(columns: list[str]) -> list[Column]:
    """rows and checksum, independent of order and files."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(columns))), F.lit(0)).alias("checksum")]


def checksum(df: DataFrame) -> DataFrame:
    """One row (rows, checksum)."""
    return df.agg(*_sums(df.columns))


class Database(ABC):
    """Named columns, their versions, and snapshots over all columns."""

    def __init__(self, spark: SparkSession, name: str, columns: dict[str, T.StructType], read_only: bool = False):
        self.spark, self.name, self.columns, self.read_only = spark, name, dict(columns), read_only

    # versions

    @abstractmethod
    def head(self) -> int: ...

    @abstractmethod
    def load(self, column: str, version: int) -> DataFrame: ...

    @abstractmethod
    def commit(self, expected: int, new: dict[str, DataFrame | Delta]) -> int:
        """Make version ``expected + 1`` with the new columns or deltas; Conflict if the head has moved."""

    @abstractmethod
    def take_snapshot(self) -> Snapshot: ...

    @abstractmethod
    def locked(self):
        """A context in which no other pessimistic writer is at work."""

    @abstractmethod
    def release_snapshot(self, snapshot: Snapshot) -> None: ...

    @abstractmethod
    def _pinned(self) -> dict[str, int]: ...

    def read(self, column: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A column now or in a snapshot; an unknown or released snapshot is an error."""
        if column not in self.columns:
            raise KeyError(f"no column {column}")
        if snapshot is None:
            return self.load(column, self.head())
        if self._pinned().get(snapshot.id) != snapshot.version:
            raise KeyError(f"unknown snapshot {snapshot.id}")
        return self.load(column, snapshot.version)

    def transact(self, fn: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame | Delta]], retries: int = 20, isolation: Isolation = Isolation.OPTIMISTIC) -> int:
        """Commit what ``fn`` makes of a reader of one version: new columns or deltas.

        Optimistic: ``fn`` runs again after a conflict.  Pessimistic: a lock keeps
        other pessimistic writers out meanwhile.  Plain: what ``fn`` made of an
        older version is put upon a newer one.
        """
        if self.read_only:
            raise PermissionError("the database is open for reading")
        if isolation is Isolation.PESSIMISTIC:
            with self.locked():
                return self.transact(fn, retries)
        made = fn(lambda column, v=self.head(): self.load(column, v)) if isolation is Isolation.PLAIN else None
        for turn in range(retries):
            version = self.head()
            try:
                return self.commit(version, made if made is not None else fn(lambda column, v=version: self.load(column, v)))
            except Conflict:
                time.sleep(backoff(turn, unit=random.random()) / 1000)
        raise Conflict(f"{retries} commits were overtaken")

    def changed_rows(self, column: str, old: Snapshot, new: Snapshot | None = None) -> DataFrame:
        """(key, previous, current) between two versions of a column of entries."""
        from kvloom.operators.table import deltas_between

        return deltas_between(KVTable(self.read(column, old)), KVTable(self.read(column, new)))

    # handles

    def dictionary(self, column: str, mode: UpdateMode = UpdateMode.ALLOW) -> Dictionary:
        return Dictionary(self, column, mode)

    def collection(self, column: str, levels: list[KeyLevel], value: T.DataType, mode: UpdateMode = UpdateMode.ALLOW) -> Node:
        """A nested map, map or set whose key levels are columns of the stored table."""
        return Node(StoredHolder(self, column, mode), Shape(tuple(levels), value))

    def cell(self, column: str, name: str, default: Any = None) -> Cell:
        return Cell.open(self._cells(column), name, default)

    def long_counter(self, column: str, name: str, default: int = 0) -> LongCounter:
        return LongCounter.open(self._cells(column), name, default)

    def int_counter(self, column: str, name: str, default: int = 0) -> IntCounter:
        return IntCounter.open(self._cells(column), name, default)

    def _cells(self, column: str) -> Node:
        schema = self.columns[column]
        return self.collection(column, [KeyLevel(schema[0].name, schema[0].dataType)], schema[1].dataType)

    # maintenance

    def ingest(self, column: str, paths: list[str], replace_existing: bool = True) -> int:
        """Load sorted runs (Parquet files of entries); an unknown column is an error."""
        if column not in self.columns:
            raise KeyError(f"no column {column}")
        run = self.spark.read.schema(self.columns[column]).parquet(*paths)
        return self.transact(lambda read: {column: Delta(KVTable(read(column)).ingest(run, replace_existing).written)})

    def ingest_all(self, path: str, replace_existing: bool = True) -> list[str]:
        """Load the runs under ``path``, in a folder for each column; the columns loaded."""
        found = [c for c in Folder(self.spark, path).names() if c in self.columns]
        for column in found:
            self.ingest(column, [f"{path}/{column}"], replace_existing)
        return found

    def export(self, column: str, path: str, most_rows: int = 10_000_000, keys: KeyRange | None = None) -> None:
        """Entries in key order into files of at most ``most_rows``."""
        df = self.read(column)
        (df.where(keys.predicate("key")) if keys else df).repartitionByRange("key").sortWithinPartitions("key").write.option("maxRecordsPerFile", most_rows).parquet(path)

    def dump(self, column: str) -> DataFrame:
        """(column, key, value) with key and value in base64."""
        return self.read(column).select(F.lit(column).alias("column"), F.base64("key").alias("key"), F.base64("value").alias("value"))

    def dump_json(self) -> str:
        """All columns as one JSON text; for small databases, as it is built on the driver."""
        found = {c: [{"key": r.key, "value": r.value} for r in self.dump(c).orderBy("key").toLocalIterator()] for c in self.columns}
        return json.dumps({"columns": found})

    def compact(self) -> int:
        """Rewrite all columns as ordered files."""
        return self.transact(lambda read: {c: read(c).repartitionByRange(schema[0].name).sortWithinPartitions(schema[0].name) for c, schema in self.columns.items()})

    def verify(self, column: str | None = None) -> DataFrame:
        """(column, rows, checksum, expected, sound) against what was recorded at the commits, run by run."""
        rows = []
        for c in [column] if column else list(self.columns):
            now, then = self._now(c), self._recorded(c)
            rows.append((c, self.read(c).count(), now, then, then is None or then == now))
        return self.spark.createDataFrame(rows, "column string, rows long, checksum long, expected long, sound boolean")

    def _now(self, column: str) -> int:
        return checksum(self.read(column)).first().checksum

    def _recorded(self, column: str) -> int | None:
        return None

    def verify_files(self, column: str, keys: KeyRange | None = None) -> DataFrame:
        """(file, rows, checksum, first, last) of the files of a column, as they are: a key may be in several runs."""
        df = self.stored(column).where((keys or KeyRange.all()).predicate("key"))
        return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("key", "value")).alias("checksum"), F.min("key").alias("first"), F.max("key").alias("last"))

    def scan_events(self, column: str):
        """Progress of a scan file by file, as it goes: (event, file, rows) with event start, ok or fail, then one report of all rows."""
        total = 0
        for file in self.files(column):
            yield ("start", file, 0)
            try:
                rows = self.spark.read.schema(self.columns[column]).parquet(file).agg(F.count("key"), F.bit_xor(F.xxhash64("key", "value"))).first()[0]
            except Exception as error:  # noqa: BLE001  any unreadable file is one event
                yield ("fail", f"{file}: {str(error).splitlines()[0]}", 0)
                continue
            total += rows
            yield ("ok", file, rows)
        yield ("report", column, total)

    def stored(self, column: str) -> DataFrame:
        """The rows of all files of a column, before runs are merged."""
        return self.read(column)

    def files(self, column: str) -> list[str]:
        return self.stored(column).inputFiles()

    def properties(self) -> DataFrame:
        """(column, version, files, rows, bytes)."""
        head = self.head()
        rows = [(c, head, len(self.files(c)), self.read(c).count(), self._bytes(c)) for c in self.columns]
        return self.spark.createDataFrame(rows, "column string, version long, files long, rows long, bytes long")

    def _bytes(self, column: str) -> int:
        return 0


class MemoryDatabase(Database):
    def __init__(self, spark: SparkSession, name: str, columns: dict[str, T.StructType]):
        super().__init__(spark, name, columns)
        self.versions = [{c: spark.createDataFrame([], s) for c, s in columns.items()}]
        self.pins: dict[str, int] = {}
        self._commits, self._writers = threading.Lock(), threading.RLock()

    def head(self) -> int:
        return len(self.versions) - 1

    def load(self, column: str, version: int) -> DataFrame:
        return self.versions[version][column]

    def commit(self, expected: int, new: dict[str, DataFrame | Delta]) -> int:
        with self._commits:
            if expected != self.head():
                raise Conflict(str(expected))
            held = self.versions[-1]
            # a delta often reads the table it goes into: pinned, the plan doesn't hold itself twice
            made = {c: written_into(held[c], pinned(x.rows.select(*self.columns[c].names))) if isinstance(x, Delta) else x.select(*self.columns[c].names) for c, x in new.items()}
            self.versions.append(held | made)
            return self.head()

    def locked(self):
        return self._writers

    def take_snapshot(self) -> Snapshot:
        snapshot = Snapshot(uuid.uuid4().hex, self.head())
        self.pins[snapshot.id] = snapshot.version
        return snapshot

    def release_snapshot(self, snapshot: Snapshot) -> None:
        if self.pins.pop(snapshot.id, None) is None:
            raise KeyError(f"unknown snapshot {snapshot.id}")

    def _pinned(self) -> dict[str, int]:
        return self.pins

    def ingest(self, column: str, paths: list[str], replace_existing: bool = True) -> int:
        raise NotImplementedError("a memory database takes no files")


class DiskDatabase(Database):
    def __init__(self, spark: SparkSession, settings: LocalSettings, name: str, columns: dict[str, T.StructType]):
        super().__init__(spark, name, columns, settings.read_only)
        self.settings, self.folder = settings, Folder(spark, f"{settings.path.rstrip('/')}/database_{name}")
        if not self.folder.exists("versions"):
            if settings.read_only:
                raise FileNotFoundError(self.folder.root)
            try:
                self.folder.create(json.dumps({"columns": {}}), "versions", _version_name(0))
            except Conflict:
                pass  # another process has made it

    def head(self) -> int:
        return max(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return json.loads(self.folder.read("versions", _version_name(version)))["columns"]

    def runs(self, column: str, version: int | None = None) -> list[dict]:
        """The runs of a column, the base first."""
        return self.manifest(self.head() if version is None else version).get(column, [])

    def load(self, column: str, version: int) -> DataFrame:
        return self._merged(column, self.runs(column, version))

    def _run(self, column: str, run: dict) -> DataFrame:
        return self.spark.read.schema(self.columns[column]).parquet(self.folder.at("data", column, run["id"]))

    def stored(self, column: str) -> DataFrame:
        out = self.spark.createDataFrame([], self.columns[column])
        for run in self.runs(column):
            out = out.unionByName(self._run(column, run))
        return out

    def _latest(self, column: str, deltas: list[dict]) -> DataFrame:
        """The last written row of each key of the deltas."""
        if len(deltas) == 1:
            return self._run(column, deltas[0])
        *keys, value = self.columns[column].names
        frames = [self._run(column, run).withColumn("__seq", F.lit(i)) for i, run in enumerate(deltas)]
        rows = frames[0]
        for df in frames[1:]:
            rows = rows.unionByName(df)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(value), "__seq").alias("__last"))
        return last.select(*keys, F.col(f"__last.{value}").alias(value))

    def _merged(self, column: str, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.columns[column])
        base = self._run(column, runs[0])
        if len(runs) == 1:
            return base
        latest = self._latest(column, runs[1:])
        *keys, value = self.columns[column].names
        gone = latest.select(*keys)
        small = sum(run["rows"] for run in runs[1:]) <= MOST_SENT
        kept = base.join(F.broadcast(gone) if small else gone, keys, "left_anti")
        return kept.unionByName(latest.where(F.col(value).isNotNull()))

    def _write(self, column: str, df: DataFrame) -> dict:
        """A new run; its sums are taken while it is written."""
        id_, told = uuid.uuid4().hex, Observation()
        rows = df.select(*self.columns[column].names)
        writer = rows.observe(told, *_sums(rows.columns)).write.option("compression", self.settings.compression)
        if self.settings.bloom_keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.columns[column][0].name}", "true")
        writer.parquet(self.folder.at("data", column, id_))
        return {"id": id_, "rows": told.get["rows"], "checksum": told.get["checksum"]}

    def commit(self, expected: int, new: dict[str, DataFrame | Delta]) -> int:
        held = dict(self.manifest(expected))
        for column, change in new.items():
            runs = held.get(column, [])
            if not isinstance(change, Delta):
                held[column] = [self._write(column, change)]
                continue
            if not runs:
                held[column] = [self._write(column, change.rows.where(F.col(self.columns[column].names[-1]).isNotNull()))]
                continue
            run = self._write(column, change.rows.coalesce(self._parts()))
            held[column] = self._settled(column, [*runs, run] if run["rows"] else runs)
        self.folder.create(json.dumps({"columns": held}), "versions", _version_name(expected + 1))
        return expected + 1

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _settled(self, column: str, runs: list[dict]) -> list[dict]:
        """The runs, merged where there are many."""
        base, deltas = runs[0], runs[1:]
        if len(deltas) <= MOST_RUNS:
            return runs
        if sum(run["rows"] for run in deltas) >= REWRITE * base["rows"]:
            return [self._write(column, self._merged(column, runs))]
        return [base, self._write(column, self._latest(column, deltas))]

    @contextmanager
    def locked(self, wait: float = 60.0):
        """A lock file; a writer that died leaves it behind, and it is then to be deleted by hand."""
        start = time.monotonic()
        while True:
            try:
                self.folder.create(json.dumps({"process": os.getpid()}), "locks", "writer")
                break
            except Conflict:
                if time.monotonic() - start > wait:
                    raise
                time.sleep(0.05)
        try:
            yield
        finally:
            self.folder.delete("locks", "writer")

    def take_snapshot(self) -> Snapshot:
        snapshot = Snapshot(uuid.uuid4().hex, self.head())
        self.folder.create(json.dumps({"version": snapshot.version}), "pins", snapshot.id)
        return snapshot

    def release_snapshot(self, snapshot: Snapshot) -> None:
        if not self.folder.exists("pins", snapshot.id):
            raise KeyError(f"unknown snapshot {snapshot.id}")
        self.folder.delete("pins", snapshot.id)

    def _pinned(self) -> dict[str, int]:
        return {n: json.loads(self.folder.read("pins", n))["version"] for n in self.folder.names("pins") if not n.endswith(".crc")}

    def _now(self, column: str) -> int:
        total = 0
        for run in self.runs(column):
            total ^= checksum(self._run(column, run)).first().checksum
        return total

    def _recorded(self, column: str) -> int | None:
        total = 0
        for run in self.runs(column):
            total ^= run["checksum"]
        return total

    def approximate_size(self, column: str) -> int:
        """Rows as recorded at the commits, an upper bound once there are deltas; nothing is scanned."""
        return sum(run["rows"] for run in self.runs(column))

    def _bytes(self, column: str) -> int:
        return sum(self.folder.size("data", column, run["id"]) for run in self.runs(column))

    def vacuum(self) -> list[str]:
        """Delete data that neither the head nor a pinned version uses; no writer may be at work."""
        used = {(c, run["id"]) for v in {self.head(), *self._pinned().values()} for c, runs in self.manifest(v).items() for run in runs}
        gone = [(c, i) for c in self.folder.names("data") for i in self.folder.names("data", c) if (c, i) not in used]
        for c, i in gone:
            self.folder.delete("data", c, i)
        return [f"{c}/{i}" for c, i in gone]

    def all_versions(self, column: str) -> DataFrame:
        """(version, key, value) of every version that is still on disk, old values and deleted keys included."""
        frames = [self.spark.createDataFrame([], self.columns[column]).withColumn("version", F.lit(0))]
        for name in self.folder.names("versions"):
            if not name.endswith(".json"):
                continue  # a commit at work
            version = int(name.removesuffix(".json"))
            runs = self.runs(column, version)
            if runs and all(self.folder.exists("data", column, run["id"]) for run in runs):
                frames.append(self.load(column, version).withColumn("version", F.lit(version)))
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def read_file(self, column: str, file: str, part: FileRange) -> DataFrame:
        """Rows of one file: none, all, a window of row numbers in key order, or keys."""
        df = self.spark.read.schema(self.columns[column]).parquet(file)
        if part.kind == "none":
            return df.limit(0)
        if part.kind == "offset":
            place = F.col("__row")
            rows = indexed(df, ["key"], "__row").where((place >= (part.low or 0)) & (place < part.high if part.high is not None else F.lit(True)))
            return rows.drop("__row")
        return df.where(part.keys().predicate("key"))

    def backup(self, path: str) -> None:
        """Copy the head, which never changes, as the first version of a database elsewhere."""
        head = self.head()
        other = Folder(self.spark, path)
        held = self.manifest(head)
        for column, runs in held.items():
            for run in runs:
                self._run(column, run).write.parquet(other.at("data", column, run["id"]))
        other.create(json.dumps({"columns": held}), "versions", _version_name(0))


def _version_name(version: int) -> str:
    return f"{version:012d}.json"


@dataclass(frozen=True)
class Dictionary:
    """A column of entries; every write is one commit."""

    database: Database
    column: str
    mode: UpdateMode

    def table(self, snapshot: Snapshot | None = None) -> KVTable:
        return KVTable(self.database.read(self.column, snapshot), mode=self.mode)

    def write(self, operation: Callable[[KVTable], Any]) -> DataFrame | None:
        """Run an operation of KVTable that gives a Change and commit its table; returns the result, which reads the old version."""
        told = []

        def step(read):
            change = operation(KVTable(read(self.column), mode=self.mode))
            told[:] = [change.result]
            return {self.column: Delta(change.written) if change.written is not None else change.table.df}

        self.database.transact(step)
        return told[0]


class StoredHolder(Holder):
    """A collection's table in a database column."""

    def __init__(self, database: Database, column: str, mode: UpdateMode):
        self.database, self.column, self.mode = database, column, mode

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.database.read(self.column, snapshot)

    def snapshot(self) -> Snapshot:
        return self.database.take_snapshot()

    def change(self, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.database.transact(lambda read: {self.column: fn(read(self.column))})

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.database.transact(lambda read: {self.column: Delta(fn(read(self.column)))})


class WriteBatch:
    """Puts and removals gathered on the driver and committed ``most`` at a time, and at the end of the context."""

    def __init__(self, dictionary: Dictionary, most: int = 50_000):
        self.dictionary, self.most, self.pairs, self.commits = dictionary, most, [], 0

    def put(self, key: Any, value: Any) -> None:
        self.pairs.append((key, value))
        if len(self.pairs) >= self.most:
            self.flush()

    def remove(self, key: Any) -> None:
        self.put(key, None)

    def flush(self) -> None:
        if self.pairs:
            pairs, self.pairs = self.pairs, []
            self.dictionary.write(lambda t: t.put_multi(pairs))
            self.commits += 1

    def __enter__(self) -> WriteBatch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.flush()


@dataclass
class Connection:
    """Databases of one configuration; connect() before use."""

    spark: SparkSession
    settings: Any
    connected: bool = False
    open: dict[str, Database] = field(default_factory=dict)

    def connect(self) -> Connection:
        if self.connected:
            raise RuntimeError("already connected")
        self.connected = True
        return self

    def disconnect(self) -> None:
        if not self.connected:
            raise RuntimeError("not connected")
        self.connected = False
        self.open.clear()

    def get_database(self, name: str, columns: dict[str, T.StructType]) -> Database:
        if not self.connected:
            raise RuntimeError("not connected")
        if name not in self.open:
            settings = self.settings
            while isinstance(settings, MultiSettings):
                settings = settings.databases.get(name, settings.default)
            self.open[name] = MemoryDatabase(self.spark, name, columns) if isinstance(settings, MemorySettings) else DiskDatabase(self.spark, settings, name, columns)
        return self.open[name]


@dataclass(frozen=True)
class CompositeSnapshot:
    """Snapshots of several databases by name."""

    parts: dict[str, Snapshot]

    @classmethod
    def take(cls, databases: list[Database]) -> CompositeSnapshot:
        return cls({d.name: d.take_snapshot() for d in databases})

    def of(self, database: Database) -> Snapshot:
        return self.parts[database.name]

    def release(self, databases: list[Database]) -> None:
        for d in databases:
            d.release_snapshot(self.parts[d.name])


@dataclass(frozen=True)
class CompositeDatabase:
    """Several databases as one: their columns by database name, one snapshot over all."""

    databases: dict[str, Database]

    def read(self, name: str, column: str, snapshot: CompositeSnapshot | None = None) -> DataFrame:
        database = self.databases[name]
        return database.read(column, snapshot.of(database) if snapshot else None)

    def take_snapshot(self) -> CompositeSnapshot:
        return CompositeSnapshot.take(list(self.databases.values()))

    def release_snapshot(self, snapshot: CompositeSnapshot) -> None:
        snapshot.release(list(self.databases.values()))

    def verify(self) -> DataFrame:
        """(database, column, rows, checksum, expected, sound) of all columns."""
        frames = [d.verify().withColumn("database", F.lit(name)) for name, d in self.databases.items()]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out.select("database", "column", "rows", "checksum", "expected", "sound")

    def compact(self) -> None:
        for database in self.databases.values():
            database.compact()
