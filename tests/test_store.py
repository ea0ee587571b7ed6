"""Databases: versions, snapshots, conflicts, ingestion, maintenance, streams, tools."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions.ranges import FileRange, KeyRange
from kvloom.operators.stages import KeyLevel
from kvloom.operators.table import KVTable
from kvloom.sources import cli, store
from kvloom.sources.store import BINARY_ENTRY, CompositeSnapshot, Conflict, Connection, DiskDatabase, LocalSettings, MemorySettings, MultiSettings, map_column, set_column, special_column
from kvloom.streaming import tables

ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType())])
CELLS = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.LongType())])
COLUMNS = {"hash_map_testmap": ENTRY, "longs": CELLS, tables.PROGRESS: tables.PROGRESS_SCHEMA}


@pytest.fixture(params=["disk", "memory"])
def database(request, spark, tmp_path):
    settings = LocalSettings(str(tmp_path)) if request.param == "disk" else MemorySettings()
    return Connection(spark, settings).connect().get_database("d", COLUMNS)


def state(database, snapshot=None):
    return {r.key: r.value for r in database.read("hash_map_testmap", snapshot).collect()}


def test_snapshots_stay_and_conflicts_retry(database):
    held = database.dictionary("hash_map_testmap")
    held.write(lambda t: t.put_multi([(1, "a"), (2, "b")]))
    before = database.take_snapshot()
    old = held.table(before).scan()
    held.write(lambda t: t.put(1, "c"))
    assert state(database) == {1: "c", 2: "b"} and state(database, before) == {1: "a", 2: "b"} and old.count() == 2
    assert {r.key: (r.previous, r.current) for r in database.changed_rows("hash_map_testmap", before).collect()} == {1: ("a", "c")}
    turns = []

    def slow(read):
        turns.append(1)
        mine = read("hash_map_testmap")
        if len(turns) == 1:
            held.write(lambda t: t.put(3, "other"))
        return {"hash_map_testmap": mine.where("key <> 2")}

    database.transact(slow)
    assert len(turns) == 2 and state(database) == {1: "c", 3: "other"}
    with pytest.raises(Conflict):
        database.commit(0, {})
    database.release_snapshot(before)
    with pytest.raises(KeyError):
        database.read("hash_map_testmap", before)
    with pytest.raises(KeyError):
        database.release_snapshot(before)


def test_unknown_columns(database):
    with pytest.raises(KeyError):
        database.read("nope")


def test_cells_and_counters(database):
    cell = database.cell("longs", "x", 7)
    assert cell.get().first().value == 7
    counter = database.long_counter("longs", "n")
    assert counter.add_and_get(5).first().value == 5
    assert database.long_counter("longs", "n").get().first().value == 5


def test_collections_are_stored(database):
    node = database.collection("hash_map_testmap", [KeyLevel("key", T.LongType())], T.StringType())
    node.put_multi({1: "a", 2: "b"})
    pin = node.holder.snapshot()
    node.remove(1)
    assert node.leaves_count().first().leaves == 1 and node.leaves_count(pin).first().leaves == 2


def test_streams_commit_once(database, spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], ENTRY).write.parquet(source)
    stream = spark.readStream.schema(ENTRY).parquet(source)
    tables.upsert_into(stream, database, "hash_map_testmap", "s", F.col("value"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert state(database) == {1: "b", 2: "c"}
    head = database.head()
    tables._once(database, "s", 0, lambda read: {"hash_map_testmap": read("hash_map_testmap").limit(0)})
    assert state(database) == {1: "b", 2: "c"} and database.head() >= head


def test_windowed_counts(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType())])
    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b")], "ts string, k string").select(F.col("ts").cast("timestamp"), "k").write.parquet(str(tmp_path / "w"))
    counts = tables.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "w")), "ts", "k", "5 minutes", "1 minute")
    counts.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.minute, r.k, r.n) for r in spark.table("windowed").collect()) == [(0, "a", 2), (5, "b", 1)]


def test_ingest_and_maintenance(spark, tmp_path):
    base = str(tmp_path / "base")
    database = Connection(spark, LocalSettings(base, bloom_keys=True)).connect().get_database("d", {"hash_map_testmap": ENTRY})
    run = str(tmp_path / "run")
    spark.createDataFrame([(1, "new"), (3, "new")], ENTRY).write.parquet(run)
    database.dictionary("hash_map_testmap").write(lambda t: t.put_multi([(1, "old"), (2, "old")]))
    database.ingest("hash_map_testmap", [run], replace_existing=False)
    assert state(database) == {1: "old", 2: "old", 3: "new"}
    database.ingest("hash_map_testmap", [run])
    assert state(database) == {1: "new", 2: "old", 3: "new"} and database.approximate_size("hash_map_testmap") >= 3
    with pytest.raises(KeyError):
        database.ingest("nope", [run])
    assert all(r.sound for r in database.verify().collect()) and database.verify_files("hash_map_testmap", KeyRange.since(2)).agg(F.sum("rows")).first()[0] == 3  # key 3 is in two runs
    assert {(r.version, r.value) for r in database.all_versions("hash_map_testmap").where("key = 1").collect()} == {(1, "old"), (2, "old"), (3, "new")}
    events = list(database.scan_events("hash_map_testmap"))
    assert events[-1] == ("report", "hash_map_testmap", 5) and sum(e[2] for e in events if e[0] == "ok") == 5
    bad = database.files("hash_map_testmap")[0].removeprefix("file://").removeprefix("file:")
    whole = open(bad, "rb").read()
    open(bad, "wb").write(whole[: len(whole) // 2])
    crc = os.path.join(os.path.dirname(bad), f".{os.path.basename(bad)}.crc")
    os.rename(crc, crc + ".old")
    assert [e[0] for e in database.scan_events("hash_map_testmap")].count("fail") == 1
    open(bad, "wb").write(whole)
    os.rename(crc + ".old", crc)
    pin = database.take_snapshot()
    database.compact()
    assert database.vacuum() == [] and state(database, pin) == state(database) == {1: "new", 2: "old", 3: "new"}
    database.release_snapshot(pin)
    assert len(database.vacuum()) == 3 and state(database) == {1: "new", 2: "old", 3: "new"}
    database.export("hash_map_testmap", str(tmp_path / "out"), keys=KeyRange.until(3))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert database.properties().first().rows == 3 and database.properties().first().bytes > 0
    database.backup(str(tmp_path / "copy" / "database_d"))
    copy = Connection(spark, LocalSettings(str(tmp_path / "copy"), read_only=True)).connect().get_database("d", {"hash_map_testmap": ENTRY})
    assert state(copy) == {1: "new", 2: "old", 3: "new"}
    with pytest.raises(PermissionError):
        copy.dictionary("hash_map_testmap").write(lambda t: t.clear())
    part = lambda text: database.read_file("hash_map_testmap", database.folder.at("data", "hash_map_testmap", database.manifest(database.head())["hash_map_testmap"][0]["id"]), FileRange.parse(text)).count()
    assert [part("full"), part("none"), part("offset-1-3")] == [3, 0, 2]


def runs(database, column="hash_map_testmap"):
    return [r["rows"] for r in database.runs(column)]


def test_a_write_appends_only_its_keys(spark, tmp_path):
    database = Connection(spark, LocalSettings(str(tmp_path))).connect().get_database("d", COLUMNS)
    held = database.dictionary("hash_map_testmap")
    held.write(lambda t: t.put_multi([(i, "v") for i in range(1000)]))
    held.write(lambda t: t.put(7, "w"))
    held.write(lambda t: t.remove([8, 5000]))
    held.write(lambda t: t.update(lambda old: F.upper(old), [9]))
    held.write(lambda t: t.remove_first(KeyRange.since(100)))
    assert runs(database) == [1000, 1, 2, 1, 1] and database.folder.size("data", "hash_map_testmap", database.runs("hash_map_testmap")[1]["id"]) < 2000
    want = {i: "v" for i in range(1000)} | {7: "w", 9: "V"}
    del want[8], want[100]
    assert state(database) == want and all(r.sound for r in database.verify("hash_map_testmap").collect())
    plan = database.read("hash_map_testmap").where("key = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,7)" in plan


def test_many_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_RUNS", 2)
    database = Connection(spark, LocalSettings(str(tmp_path))).connect().get_database("d", COLUMNS)
    held, want = database.dictionary("hash_map_testmap"), {i: "v" for i in range(30)}
    held.write(lambda t: t.put_multi(list(want.items())))
    seen = []
    for i in range(8):
        held.write(lambda t, i=i: t.put_multi([(i, f"n{i}"), (i + 1, None)]))
        want[i] = f"n{i}"
        want.pop(i + 1, None)
        seen.append(runs(database))
        assert state(database) == want
    assert max(len(x) for x in seen) == 3 and [30, 4] in seen and any(len(x) == 1 for x in seen)


def test_writers_by_isolation(database):
    held = database.dictionary("hash_map_testmap")
    held.write(lambda t: t.put_multi([(1, "a"), (2, "b")]))
    for isolation, turns in ((store.Isolation.OPTIMISTIC, 2), (store.Isolation.PESSIMISTIC, 1), (store.Isolation.PLAIN, 1)):
        seen = []

        def add(read, seen=seen, isolation=isolation):
            seen.append(1)
            if len(seen) == 1 and isolation is not store.Isolation.PESSIMISTIC:
                held.write(lambda t: t.put(3, isolation.value))
            return {"hash_map_testmap": store.Delta(KVTable(read("hash_map_testmap")).put(4, isolation.value).written)}

        database.transact(add, isolation=isolation)
        assert len(seen) == turns and state(database)[4] == isolation.value
    assert state(database) == {1: "a", 2: "b", 3: "plain", 4: "plain"}


def test_locks_keep_writers_apart(spark, tmp_path):
    database = Connection(spark, LocalSettings(str(tmp_path))).connect().get_database("d", COLUMNS)
    with database.locked(), pytest.raises(Conflict), database.locked(wait=0.2):
        pass
    with database.locked(wait=0.2):
        pass


def test_write_batches(database):
    with store.WriteBatch(database.dictionary("hash_map_testmap"), most=3) as batch:
        for i in range(7):
            batch.put(i, "x")
        batch.remove(2)
    assert batch.commits == 3 and sorted(state(database)) == [0, 1, 3, 4, 5, 6]


def test_int_counters_wrap(database):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.IntegerType())])
    database.columns["ints"] = schema
    if not isinstance(database, DiskDatabase):
        database.versions[-1]["ints"] = database.spark.createDataFrame([], schema)
    counter = database.int_counter("ints", "n", 2**31 - 2)
    assert [counter.increment_and_get().first().value, counter.increment_and_get().first().value, counter.get_and_add(-1).first().value] == [2**31 - 1, -(2**31), -(2**31)]
    assert counter.get().first().value == 2**31 - 1


def test_composite_database(spark, tmp_path):
    connection = Connection(spark, MultiSettings({"a": MemorySettings()}, LocalSettings(str(tmp_path)))).connect()
    both = store.CompositeDatabase({n: connection.get_database(n, {"hash_map_testmap": ENTRY}) for n in "ab"})
    pin = both.take_snapshot()
    for d in both.databases.values():
        d.dictionary("hash_map_testmap").write(lambda t: t.put(1, "x"))
    assert both.read("a", "hash_map_testmap", pin).count() == 0 and both.read("b", "hash_map_testmap").count() == 1
    both.compact()
    assert all(r.sound for r in both.verify().collect()) and both.verify().count() == 2
    both.release_snapshot(pin)
    with pytest.raises(KeyError):
        both.read("b", "hash_map_testmap", pin)


def test_ingest_all(spark, tmp_path):
    database = Connection(spark, LocalSettings(str(tmp_path / "base"))).connect().get_database("d", COLUMNS)
    spark.createDataFrame([(1, "a")], ENTRY).write.parquet(str(tmp_path / "runs" / "hash_map_testmap"))
    spark.createDataFrame([(1, "a")], ENTRY).write.parquet(str(tmp_path / "runs" / "unknown"))
    assert database.ingest_all(str(tmp_path / "runs")) == ["hash_map_testmap"] and state(database) == {1: "a"}


def test_connections(spark, tmp_path):
    settings = MultiSettings({"a": MemorySettings()}, LocalSettings(str(tmp_path)))
    connection = Connection(spark, settings)
    with pytest.raises(RuntimeError):
        connection.get_database("a", COLUMNS)
    connection.connect()
    with pytest.raises(RuntimeError):
        connection.connect()
    a, b = connection.get_database("a", COLUMNS), connection.get_database("b", COLUMNS)
    assert isinstance(b, DiskDatabase) and not isinstance(a, DiskDatabase) and connection.get_database("a", COLUMNS) is a
    both = CompositeSnapshot.take([a, b])
    a.dictionary("hash_map_testmap").write(lambda t: t.put(1, "x"))
    assert state(a, both.of(a)) == {} and state(a) == {1: "x"}
    both.release([a, b])
    connection.disconnect()
    with pytest.raises(FileNotFoundError):
        Connection(spark, LocalSettings(str(tmp_path), read_only=True)).connect().get_database("none", COLUMNS)
    assert (map_column("m"), set_column("s"), special_column("x")) == ("hash_map_m", "hash_set_s", "x")


def test_tools(spark, tmp_path):
    database = Connection(spark, LocalSettings(str(tmp_path))).connect().get_database("d", {"c": BINARY_ENTRY})
    database.dictionary("c").write(lambda t: t.put_multi([(b"\x01", b"a"), (b"\x02", b"b")]))
    run = lambda *args: cli.run(spark, cli.parser().parse_args(["--path", str(tmp_path), "--database", "d", *args]))
    assert run("list-column-families") == ["c"] and run("scan-all") == ["c\t2"]
    assert json.loads(run("dump-all")[0]) == {"columns": {"c": [{"key": "AQ==", "value": "YQ=="}, {"key": "Ag==", "value": "Yg=="}]}}
    assert json.loads(run("verify-checksum", "c")[0])["sound"] and len(run("list-files")) >= 1
    assert sum(int(x.split("\t")[1]) for x in run("--range", "single-key-02", "scan-files")) == 1
    assert run("--out", str(tmp_path / "o"), "export-files") == [f"{tmp_path}/o/c"]
