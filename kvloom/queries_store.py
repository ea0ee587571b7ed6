"""Registered queries of connections, stored columns, transactions, files, maintenance and tools."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions.ranges import FileRange, KeyRange
from kvloom.operators.deltas import UpdateMode
from kvloom.operators.metrics import Timers, observed
from kvloom.operators.stages import KeyLevel
from kvloom.operators.table import KVTable
from kvloom.queries import _stored_orders, byte_orders, hexed, orders, query, table
from kvloom.sources import cli
from kvloom.sources.scratch import shared_folder
from kvloom.sources.store import CompositeDatabase, Connection, Delta, Isolation, LocalSettings, MemorySettings, MultiSettings, WriteBatch, map_column, set_column, special_column

ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType())])
CELLS = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType())])


def base(spark) -> str:
    return f"{shared_folder(spark)}/kvloom-store-{uuid.uuid4().hex}"


def disk(spark, path: str | None = None, **settings):
    return Connection(spark, LocalSettings(path or base(spark), **settings)).connect().get_database("d", {"orders": ENTRY, "cells": CELLS})


def filled(spark, d, **settings):
    database = disk(spark, **settings)
    database.transact(lambda read: {"orders": orders(spark, d).df})
    return database


_ORDERS = "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders"


@query(f"{_ORDERS} WHERE o_orderkey < 100")
def db_connect(spark, d):
    """A database opened again after a disconnect."""
    path = base(spark)
    connection = Connection(spark, LocalSettings(path)).connect()
    connection.get_database("d", {"orders": ENTRY}).transact(lambda read: {"orders": orders(spark, d).df})
    connection.disconnect()
    return connection.connect().get_database("d", {"orders": ENTRY}).read("orders").where("key < 100")


@query("SELECT 'hot' AS database, count(*) AS rows, 'MemoryDatabase' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'cold', count(*), 'DiskDatabase' FROM orders WHERE o_orderkey % 2 = 1")
def db_sharded(spark, d):
    """Databases of one connection in different places."""
    connection = Connection(spark, MultiSettings({"hot": MemorySettings()}, LocalSettings(base(spark)))).connect()
    frames = []
    for name, part in (("hot", 0), ("cold", 1)):
        database = connection.get_database(name, {"orders": ENTRY})
        database.transact(lambda read, part=part: {"orders": orders(spark, d).df.where(F.col("key") % 2 == part)})
        frames.append(database.read("orders").agg(F.lit(name).alias("database"), F.count(F.lit(1)).alias("rows"), F.lit(type(database).__name__).alias("kind")))
    return frames[0].unionByName(frames[1])


@query("SELECT setting, kind FROM (VALUES ('memory', 'MemoryDatabase'), ('local', 'DiskDatabase'), ('multi', 'MemoryDatabase')) s(setting, kind)")
def db_settings(spark, d):
    settings = {"memory": MemorySettings(), "local": LocalSettings(base(spark)), "multi": MultiSettings({}, MemorySettings())}
    rows = [(k, type(Connection(spark, s).connect().get_database("d", {"orders": ENTRY})).__name__) for k, s in settings.items()]
    return spark.createDataFrame(rows, "setting string, kind string")


@query("SELECT n_name AS name, 'hash_map_' || n_name AS map, 'hash_set_' || n_name AS set, n_name AS special FROM nation")
def db_column_names(spark, d):
    rows = [(r.n_name, map_column(r.n_name), set_column(r.n_name), special_column(r.n_name)) for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame(rows, "name string, map string, set string, special string")


@query("SELECT count(*) AS rows, true AS refused FROM orders")
def db_read_only(spark, d):
    path = base(spark)
    disk(spark, path).transact(lambda read: {"orders": orders(spark, d).df})
    database = disk(spark, path, read_only=True)
    try:
        database.dictionary("orders").write(lambda t: t.put(1, "x"))
        refused = False
    except PermissionError:
        refused = True
    return database.read("orders").agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("refused"))


@query(f"{_ORDERS} WHERE o_orderkey NOT IN (1, 2, 3) UNION ALL VALUES (1, 'X'), (-5, 'Y')")
def db_delta_runs(spark, d):
    """A column of a base and three deltas, merged when read."""
    database = filled(spark, d)
    held = database.dictionary("orders")
    held.write(lambda t: t.put_multi([(1, "W"), (-5, "Y")]))
    held.write(lambda t: t.remove([2, 3]))
    held.write(lambda t: t.update(lambda old: F.lit("X"), [1]))
    return database.read("orders")


@query("SELECT run, rows::BIGINT AS rows FROM (SELECT 0 AS run, count(*) AS rows FROM orders UNION ALL VALUES (1, 1), (2, 2))")
def db_runs(spark, d):
    """What a write of single keys adds to a stored column."""
    database = filled(spark, d)
    held = database.dictionary("orders")
    held.write(lambda t: t.put(5, "X"))
    held.write(lambda t: t.remove([6, 7]))
    return spark.createDataFrame([(i, r["rows"]) for i, r in enumerate(database.runs("orders"))], "run int, rows long")


def _meddled(spark, d, isolation: Isolation):
    """A transaction that another write comes before, between its reading and its commit (or not, if it is locked out)."""
    database = filled(spark, d)
    held, turns = database.dictionary("orders"), []

    def step(read):
        turns.append(1)
        mine = KVTable(read("orders"))
        if len(turns) == 1 and isolation is not Isolation.PESSIMISTIC:
            held.write(lambda t: t.put(1, "other"))
        return {"orders": Delta(mine.update(lambda old: F.concat(old, F.lit("+")), [1, 2]).written)}

    database.transact(step, isolation=isolation)
    return database.read("orders").where("key < 3").withColumn("turns", F.lit(len(turns)))


_TURNS = "SELECT o_orderkey AS key, {} AS value, {}::INTEGER AS turns FROM orders WHERE o_orderkey < 3"


@query(_TURNS.format("CASE o_orderkey WHEN 1 THEN 'other+' WHEN 2 THEN o_orderstatus || '+' ELSE o_orderstatus END", 2))
def tx_optimistic(spark, d):
    return _meddled(spark, d, Isolation.OPTIMISTIC)


@query(_TURNS.format("CASE WHEN o_orderkey > 0 THEN o_orderstatus || '+' ELSE o_orderstatus END", 1))
def tx_pessimistic(spark, d):
    return _meddled(spark, d, Isolation.PESSIMISTIC)


@query(_TURNS.format("CASE WHEN o_orderkey > 0 THEN o_orderstatus || '+' ELSE o_orderstatus END", 1))
def tx_plain(spark, d):
    return _meddled(spark, d, Isolation.PLAIN)


@query(f"{_ORDERS} WHERE o_orderkey >= 10 UNION ALL SELECT * FROM (VALUES (0::BIGINT, 'b0'), (1, 'b1'), (2, 'b2'), (4, 'b4'), (5, 'b5'), (6, 'b6'), (7, 'b7'), (8, 'b8'), (9, 'b9')) v")
def db_write_batch(spark, d):
    database = filled(spark, d)
    with WriteBatch(database.dictionary("orders"), most=4) as batch:
        for i in range(10):
            batch.put(i, f"b{i}")
        batch.remove(3)
    return database.read("orders")


@query("SELECT kind, value::BIGINT AS value FROM (VALUES ('singleton', 7), ('counter', 3), ('absent', 0)) v(kind, value)")
def db_cells(spark, d):
    database = disk(spark)
    cell, counter = database.cell("cells", "limit", 7), database.long_counter("cells", "seen")
    counter.add_and_get(5)
    counter.get_and_add(-2)
    frames = [cell.get().withColumn("kind", F.lit("singleton")), counter.get().withColumn("kind", F.lit("counter")), database.long_counter("cells", "other").get().withColumn("kind", F.lit("absent"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(f"{_ORDERS} WHERE o_orderkey <> 9 UNION ALL VALUES (9, 'Z')")
def db_collection(spark, d):
    """A stored map written by its entries."""
    node = filled(spark, d).collection("orders", [KeyLevel("key", T.LongType())], T.StringType())
    node.at(9).set("Y")
    node.at(9).update(lambda old: F.lit("Z"))
    return node.rows()


@query("SELECT 'disallow' AS mode, true AS put, false AS updated UNION ALL VALUES ('allow', true, true)")
def db_update_gate(spark, d):
    rows = []
    for mode in (UpdateMode.DISALLOW, UpdateMode.ALLOW):
        held = filled(spark, d).dictionary("orders", mode)
        held.write(lambda t: t.put(1, "x"))
        try:
            held.write(lambda t: t.update(lambda old: F.lit("y"), [1]))
            updated = True
        except PermissionError:
            updated = False
        rows.append((mode.value, held.table().get(1).first().value in ("x", "y"), updated))
    return spark.createDataFrame(rows, "mode string, put boolean, updated boolean")


# files


@query("SELECT o_orderkey AS key, o_orderstatus AS value, count(*) OVER () AS n FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 500")
def file_export(spark, d):
    path = base(spark)
    filled(spark, d).export("orders", path, most_rows=100, keys=KeyRange.of(50, 500))
    df = spark.read.parquet(path)
    return df.crossJoin(df.agg(F.count(F.lit(1)).alias("n")))


@query("SELECT s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT s_suppkey FROM supplier)")
def file_ingest(spark, d):
    path = base(spark)
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")).write.parquet(path)
    database = filled(spark, d)
    database.ingest("orders", [path])
    return database.read("orders")


@query("SELECT 'orders' AS \"column\", count(*) AS rows FROM orders UNION ALL SELECT 'cells', 2")
def file_ingest_all(spark, d):
    """Runs of all columns, found by their folders."""
    path = base(spark)
    orders(spark, d).df.write.parquet(f"{path}/orders")
    spark.createDataFrame([("a", 1), ("b", 2)], CELLS).write.parquet(f"{path}/cells")
    orders(spark, d).df.limit(1).write.parquet(f"{path}/unknown")
    database = disk(spark)
    frames = [database.read(c).agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows")) for c in database.ingest_all(path)]
    return frames[0].unionByName(frames[1])


@query("SELECT 'orders' AS \"column\", base64(unhex(format('{:016X}', o_orderkey))) AS key, base64(unhex('00000001') || encode(o_orderstatus)) AS value FROM orders WHERE o_orderkey < 200")
def file_dump_json(spark, d):
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
    database = Connection(spark, LocalSettings(base(spark))).connect().get_database("d", {"orders": schema})
    database.transact(lambda read: {"orders": byte_orders(spark, d).scan(KeyRange.until((200).to_bytes(8, "big")))})
    found = json.loads(database.dump_json())["columns"]
    return spark.createDataFrame([(c, e["key"], e["value"]) for c, entries in found.items() for e in entries], "column string, key string, value string")


@query("SELECT sum(rows)::BIGINT AS rows, min(first) AS first, max(last) AS last FROM (SELECT count(*) AS rows, format('{:016X}', min(o_orderkey)) AS first, format('{:016X}', max(o_orderkey)) AS last FROM orders)")
def file_verify_range(spark, d):
    files = hexed(_stored_orders(spark, d).verify_files("orders"), "first", "last")
    return files.agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("""SELECT form, CASE form WHEN 'none' THEN 0 WHEN 'full' THEN n WHEN 'offset-2-7' THEN 5 WHEN 'offset--4' THEN 4 ELSE k END AS rows
          FROM (SELECT count(*) AS n, count(*) FILTER (o_orderkey >= 3 AND o_orderkey < 90) AS k FROM orders), (VALUES ('none'), ('full'), ('offset-2-7'), ('offset--4'), ('key-0000000000000003-000000000000005a')) f(form)
          UNION ALL SELECT 'single-key-0000000000000005', count(*) FROM orders WHERE o_orderkey = 5""")
def file_ranges(spark, d):
    """Parts of a file by their text forms."""
    database = _stored_orders(spark, d)
    file = database.folder.at("data", "orders", database.runs("orders")[0]["id"])
    forms = ["none", "full", "offset-2-7", "offset--4", "key-0000000000000003-000000000000005a", "single-key-0000000000000005"]
    rows = [(str(FileRange.parse(f)), database.read_file("orders", file, FileRange.parse(f)).count()) for f in forms]
    return spark.createDataFrame(rows, "form string, rows long")


@query("SELECT o_orderkey AS key, version::INTEGER AS version, CASE WHEN version = 2 THEN 'X' ELSE o_orderstatus END AS value FROM orders, (VALUES (1), (2)) v(version) WHERE o_orderkey = 5")
def file_all_versions(spark, d):
    """Every value of a key that is still on disk."""
    database = filled(spark, d)
    database.dictionary("orders").write(lambda t: t.put(5, "X"))
    return database.all_versions("orders").where("key = 5").select("key", "version", "value")


@query("SELECT event, rows FROM (SELECT 'ok' AS event, count(*) AS rows FROM orders UNION ALL SELECT 'report', count(*) FROM orders UNION ALL SELECT 'start', 0)")
def file_scan_events(spark, d):
    events = spark.createDataFrame(list(_stored_orders(spark, d).scan_events("orders")), "event string, file string, rows long")
    return events.groupBy("event").agg(F.sum("rows").alias("rows"))


# maintenance


@query("SELECT count(*) AS size FROM orders")
def m_approx_size(spark, d):
    """The size recorded at the commit; nothing is scanned."""
    return spark.createDataFrame([(filled(spark, d).approximate_size("orders"),)], "size long")


@query("SELECT part::INTEGER AS part, count(*) AS rows FROM (SELECT o_orderkey // 256 AS part FROM orders WHERE o_orderkey < 1024) GROUP BY 1")
def m_parallel_count(spark, d):
    """Counts of consecutive key ranges of equal width."""
    held = byte_orders(spark, d)
    ranges = KeyRange.of((0).to_bytes(8, "big"), (1024).to_bytes(8, "big")).split(4, 8)
    frames = [held.size(r).select(F.lit(i).alias("part"), F.col("size").alias("rows")) for i, r in enumerate(ranges)]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.where("rows > 0")


@query("SELECT 'orders' AS \"column\", 1::BIGINT AS version, count(*) AS rows, true AS has_files, true AS has_bytes FROM orders")
def m_properties(spark, d):
    return _stored_orders(spark, d).properties().select("column", "version", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query(_ORDERS)
def m_backup(spark, d):
    path = base(spark)
    filled(spark, d).backup(f"{path}/database_d")
    return disk(spark, path, read_only=True).read("orders")


@query("SELECT count(*) AS runs, true AS sound FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def m_vacuum(spark, d):
    """After compaction and cleaning one run is left, and it is sound."""
    database = filled(spark, d)
    database.dictionary("orders").write(lambda t: t.put(5, "X"))
    database.compact()
    database.vacuum()
    return database.verify("orders").select(F.lit(len(database.runs("orders"))).cast("long").alias("runs"), "sound")


@query("SELECT count(*) AS rows, max(o_orderkey) AS most FROM orders")
def m_metrics(spark, d):
    """Measures taken while another query runs."""
    df, seen = observed(orders(spark, d).df, f"orders-{uuid.uuid4().hex}", most=F.max("key"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["most"])], "rows long, most long")


@query("SELECT name, times::BIGINT AS times, true AS ordered FROM (VALUES ('get', 3), ('size', 2)) v(name, times)")
def m_timers(spark, d):
    """Times of operations: how many, and that their percentiles are in order."""
    timers, held = Timers(), orders(spark, d)
    for key in (1, 2, 3):
        with timers.time("get"):
            held.get(key).collect()
    for _ in range(2):
        with timers.time("size"):
            held.size().collect()
    ordered = (F.col("p20") <= F.col("p50")) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("total"))
    return timers.report(spark).select("name", "times", ordered.alias("ordered"))


@query("SELECT compression, bloom, rows FROM (SELECT count(*) AS rows FROM orders), (VALUES ('snappy', false), ('gzip', true), ('none', false), ('zstd', true)) o(compression, bloom)")
def m_storage_options(spark, d):
    frames = []
    for compression, bloom in (("snappy", False), ("gzip", True), ("none", False), ("zstd", True)):
        database = filled(spark, d, compression=compression, bloom_keys=bloom)
        frames.append(database.read("orders").agg(F.lit(compression).alias("compression"), F.lit(bloom).alias("bloom"), F.count(F.lit(1)).alias("rows")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query("SELECT database, \"when\", rows FROM (SELECT count(*) AS n FROM orders), LATERAL (VALUES ('a', 'before', 0), ('b', 'before', 0), ('a', 'now', n), ('b', 'now', n)) v(database, \"when\", rows)")
def snap_composite(spark, d):
    """One snapshot over two databases."""
    connection = Connection(spark, MultiSettings({"a": MemorySettings()}, LocalSettings(base(spark)))).connect()
    both = CompositeDatabase({n: connection.get_database(n, {"orders": ENTRY}) for n in "ab"})
    pin = both.take_snapshot()
    for database in both.databases.values():
        database.transact(lambda read: {"orders": orders(spark, d).df})
    rows = [(n, when, both.read(n, "orders", s).count()) for n in "ab" for when, s in (("before", pin), ("now", None))]
    return spark.createDataFrame(rows, "database string, when string, rows long")


@query("SELECT command, lines FROM (SELECT count(*) AS n FROM orders), LATERAL (VALUES ('list-column-families', 'orders'), ('scan-all', 'orders' || chr(9) || n), ('verify-checksum', 'true')) v(command, lines)")
def m_tools(spark, d):
    path = base(spark)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
    Connection(spark, LocalSettings(path)).connect().get_database("d", {"orders": schema}).transact(lambda read: {"orders": byte_orders(spark, d).df})
    run = lambda *args: cli.run(spark, cli.parser().parse_args(["--path", path, "--database", "d", *args]))
    sound = str(json.loads(run("verify-checksum", "orders")[0])["sound"]).lower()
    rows = [("list-column-families", run("list-column-families")[0]), ("scan-all", run("scan-all")[0]), ("verify-checksum", sound)]
    return spark.createDataFrame(rows, "command string, lines string")
