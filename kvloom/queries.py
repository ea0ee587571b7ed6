"""Registered queries over the key-value, search and dataflow operators, each with its DuckDB SQL.

Order is not part of a result; what an operator orders is checked by keys,
positions or ordered text.  Byte keys are shown as hex text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions import codecs, text
from kvloom.functions.ranges import KeyRange
from kvloom.operators import stages, streams
from kvloom.operators.deltas import Result
from kvloom.operators.stages import Holder, KeyLevel, Node, Shape
from kvloom.operators.table import KVTable, deltas_between
from kvloom.plans import nodes as n
from kvloom.plans.compiler import text_index
from kvloom.plans.search import matches, search
from kvloom.plans.stored import StoredIndex, write_documents
from kvloom.sources.scratch import modified, shared_folder
from kvloom.sources.store import Connection, LocalSettings, MemoryDatabase
from kvloom.streaming import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = sql


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        register(fn.__name__, fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, d) -> KVTable:
    return KVTable.from_columns(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


def customers(spark, d) -> KVTable:
    return KVTable.from_columns(table(spark, d, "customer"), "c_custkey", "c_mktsegment")


def parts(spark, d) -> KVTable:
    return KVTable.from_columns(table(spark, d, "part"), "p_partkey", "p_size")


def byte_orders(spark, d) -> KVTable:
    return KVTable.from_columns(table(spark, d, "orders"), codecs.LONG.encode(F.col("o_orderkey")), codecs.TEXT.encode(F.col("o_orderstatus")))


def hexed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.hex(c) for c in names})


# reads

_ORDERS = "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders"


@query("SELECT o_orderstatus AS value FROM orders WHERE o_orderkey = 101")
def kv_get(spark, d):
    return orders(spark, d).get(101)


@query("SELECT k.pos AS pos, k.key AS key, o_orderstatus AS value FROM (VALUES (0, 5), (1, -1), (2, 1), (3, 999999999), (4, 5)) k(pos, key) LEFT JOIN orders ON o_orderkey = k.key")
def kv_multi_get(spark, d):
    return orders(spark, d).get_multi([5, -1, 1, 999999999, 5])


@query(f"{_ORDERS} WHERE o_orderkey >= 100")
def kv_range_fwd(spark, d):
    return orders(spark, d).scan(KeyRange.since(100))


@query(f"{_ORDERS} WHERE o_orderkey >= 100 AND o_orderkey < 500")
def kv_range_rev(spark, d):
    return orders(spark, d).scan(KeyRange.of(100, 500), reverse=True)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey < 700")
def kv_range_keys(spark, d):
    return orders(spark, d).scan_keys(KeyRange.until(700))


@query(f"{_ORDERS} WHERE o_orderkey >= 200 ORDER BY o_orderkey LIMIT 1")
def kv_first(spark, d):
    return orders(spark, d).first(KeyRange.since(200))


@query("SELECT min(o_orderkey) AS key FROM orders")
def kv_first_key(spark, d):
    return orders(spark, d).first_key()


@query("SELECT count(*) AS size FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1000")
def kv_range_size(spark, d):
    return orders(spark, d).size(KeyRange.of(10, 1000))


@query("SELECT count(*) AS size FROM orders WHERE o_orderkey = 7")
def kv_single_size(spark, d):
    return orders(spark, d).size(KeyRange.single(7))


@query("SELECT count(*) AS size FROM orders")
def kv_exact_size(spark, d):
    return orders(spark, d).size()


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0 AS is_empty, (SELECT count(*) FROM orders WHERE o_orderkey >= 5) = 0 AS later_is_empty")
def kv_range_empty(spark, d):
    t = orders(spark, d)
    return t.is_empty(KeyRange.until(0)).crossJoin(t.is_empty(KeyRange.since(5)).select(F.col("is_empty").alias("later_is_empty")))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 12) AS contains")
def kv_contains(spark, d):
    return orders(spark, d).contains(12)


_HEX = "format('{:016X}', o_orderkey)"


@query(f"SELECT substr({_HEX}, 1, 14) AS prefix, count(*) AS n, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS joined FROM orders GROUP BY 1")
def kv_range_grouped(spark, d):
    groups = byte_orders(spark, d).grouped(7)
    joined = F.array_join(F.transform("entries", lambda e: codecs.TEXT.decode(e["value"])), "")
    return hexed(groups.select("prefix", F.size("entries").cast("long").alias("n"), joined.alias("joined")), "prefix")


@query(f"SELECT substr({_HEX}, 1, 14) AS prefix, string_agg({_HEX}, ',' ORDER BY o_orderkey) AS joined FROM orders WHERE o_orderkey >= 256 GROUP BY 1")
def kv_keys_grouped(spark, d):
    groups = byte_orders(spark, d).grouped_keys(7, KeyRange.since((256).to_bytes(8, "big")))
    return hexed(groups.select("prefix", F.array_join(F.transform("keys", lambda k: F.hex(k)), ",").alias("joined")), "prefix")


@query(f"SELECT DISTINCT substr({_HEX}, 1, 14) AS prefix FROM orders WHERE o_orderkey < 768")
def kv_prefixes(spark, d):
    return hexed(byte_orders(spark, d).prefixes(7, KeyRange.until((768).to_bytes(8, "big"))), "prefix")


@query(f"SELECT {_HEX} AS key FROM orders WHERE {_HEX} LIKE '00000000000001%'")
def kv_prefix_range(spark, d):
    return hexed(byte_orders(spark, d).scan_keys(KeyRange.prefix((1).to_bytes(7, "big"))), "key")


# writes

_CUSTOMERS = "SELECT c_custkey AS key, c_mktsegment AS value FROM customer"


@query("SELECT k.key AS key, c_mktsegment AS previous FROM (VALUES (1), (999999999)) k(key) LEFT JOIN customer ON c_custkey = k.key")
def kv_put_prev(spark, d):
    return customers(spark, d).put_multi([(1, "NEW"), (999999999, "NEW")], Result.PREVIOUS).result


@query(f"{_CUSTOMERS} WHERE c_custkey NOT IN (1, 2, 999999999) UNION ALL VALUES (1, 'C'), (999999999, 'B')")
def kv_put_multi(spark, d):
    return customers(spark, d).put_multi([(1, "A"), (999999999, "B"), (1, "C"), (2, None)]).table.df


@query("SELECT k.key AS key, c_mktsegment AS previous FROM (VALUES (3), (888888888)) k(key) LEFT JOIN customer ON c_custkey = k.key")
def kv_remove_prev(spark, d):
    return customers(spark, d).remove([3, 888888888], Result.PREVIOUS).result


@query("SELECT k.key AS key, c_custkey IS NOT NULL AS existed FROM (VALUES (3), (888888888)) k(key) LEFT JOIN customer ON c_custkey = k.key")
def kv_remove_status(spark, d):
    return customers(spark, d).remove([3, 888888888], Result.EXISTED).result


@query(f"{_CUSTOMERS} WHERE c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_custkey >= 50)")
def kv_remove_one(spark, d):
    return customers(spark, d).remove_first(KeyRange.since(50)).table.df


@query(f"{_CUSTOMERS} WHERE c_custkey < 100")
def kv_clear_range(spark, d):
    return customers(spark, d).clear(KeyRange.since(100)).table.df


_NEXT = "CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN NULL ELSE o_orderstatus END"


def _next_status(old):
    return F.when(old == "O", "F").when(old == "F", None).otherwise(old)


@query(f"SELECT o_orderkey AS key, o_orderstatus AS previous, {_NEXT} AS current, o_orderstatus IS DISTINCT FROM {_NEXT} AS changed FROM orders")
def kv_update_delta(spark, d):
    t = orders(spark, d)
    return t.update_delta(_next_status, t.df.select("key")).result.select("key", "delta.previous", "delta.current", "changed")


@query(f"SELECT o_orderkey AS key, {_NEXT} AS value FROM orders WHERE {_NEXT} IS NOT NULL")
def kv_update_all(spark, d):
    return orders(spark, d).update_all(lambda k, old: _next_status(old)).table.df


@query("""SELECT k.key AS key, o_orderstatus AS previous, CASE WHEN o_orderkey IS NULL THEN 'N' ELSE o_orderstatus || CAST(k.key % 2 AS VARCHAR) END AS current, true AS changed
          FROM (VALUES (4), (5), (777777777)) k(key) LEFT JOIN orders ON o_orderkey = k.key""")
def kv_update_multi(spark, d):
    out = orders(spark, d).update_keyed(lambda k, old: F.coalesce(F.concat(old, (k % 2).cast("string")), F.lit("N")), [4, 5, 777777777]).result
    return out.select("key", "delta.previous", "delta.current", "changed")


_PARTS = "SELECT p_partkey AS key, p_size AS value FROM part"


@query(f"{_PARTS} WHERE NOT (p_partkey >= 10 AND p_partkey < 90) UNION ALL VALUES (11, 1), (12, 3)")
def kv_set_range(spark, d):
    return parts(spark, d).set_range(KeyRange.of(10, 90), [(11, 1), (12, 2), (12, 3)]).table.df


@query("SELECT p_partkey AS key, CASE WHEN p_partkey >= 20 AND p_partkey < 150 THEN p_size * 10 ELSE p_size END AS value FROM part")
def kv_replace_range(spark, d):
    return parts(spark, d).replace_range(KeyRange.of(20, 150), lambda k, v: (k, (v * 10).cast("int")), can_keys_change=False).table.df


@query("SELECT CASE WHEN p_partkey >= 20 AND p_partkey < 150 THEN -p_partkey ELSE p_partkey END AS key, p_size AS value FROM part")
def kv_replace_range_keys(spark, d):
    return parts(spark, d).replace_range(KeyRange.of(20, 150), lambda k, v: (-k, v)).table.df


def _supplier_run(spark, d) -> tuple[KVTable, DataFrame]:
    held = KVTable.from_columns(table(spark, d, "supplier"), "s_suppkey", "s_name")
    return held, held.df.select((F.col("key") + 5).alias("key"), F.concat(F.lit("run "), "value").alias("value"))


_RUN = "SELECT s_suppkey + 5 AS key, 'run ' || s_name AS value FROM supplier"


@query(f"{_RUN} UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey + 5 FROM supplier)")
def kv_ingest_replace(spark, d):
    held, run = _supplier_run(spark, d)
    return held.ingest(run, replace_existing=True).table.df


@query(f"SELECT s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT * FROM ({_RUN}) WHERE key NOT IN (SELECT s_suppkey FROM supplier)")
def kv_ingest_behind(spark, d):
    held, run = _supplier_run(spark, d)
    return held.ingest(run, replace_existing=False).table.df


# snapshots and maintenance

_ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType())])


def _changed_database(spark, d):
    database = MemoryDatabase(spark, "q", {"orders": _ENTRY})
    database.transact(lambda read: {"orders": orders(spark, d).df})
    before = database.take_snapshot()
    held = database.dictionary("orders")
    held.write(lambda t: t.put_multi([(1, "X"), (-7, "Y")]))
    held.write(lambda t: t.clear(KeyRange.of(100, 200)))
    return database, before


@query(_ORDERS)
def snap_read_old(spark, d):
    database, before = _changed_database(spark, d)
    return database.read("orders", before)


@query(f"{_ORDERS} WHERE o_orderkey <> 1 AND NOT (o_orderkey >= 100 AND o_orderkey < 200) UNION ALL VALUES (1, 'X'), (-7, 'Y')")
def snap_read_new(spark, d):
    return _changed_database(spark, d)[0].read("orders")


@query("""SELECT o_orderkey AS key, o_orderstatus AS previous, CASE WHEN o_orderkey = 1 THEN 'X' END AS current
          FROM orders WHERE o_orderkey = 1 OR (o_orderkey >= 100 AND o_orderkey < 200) UNION ALL SELECT -7, NULL, 'Y'""")
def snap_diff(spark, d):
    database, before = _changed_database(spark, d)
    return deltas_between(KVTable(database.read("orders", before)), KVTable(database.read("orders")))


def _stored_orders(spark, d):
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
    base = f"{shared_folder(spark)}/kvloom-store-{uuid.uuid4().hex}"
    database = Connection(spark, LocalSettings(base)).connect().get_database("m", {"orders": schema})
    database.transact(lambda read: {"orders": byte_orders(spark, d).df})
    return database


@query("SELECT 'orders' AS \"column\", count(*) AS rows, true AS sound FROM orders")
def m_verify(spark, d):
    return _stored_orders(spark, d).verify().select("column", "rows", "sound")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def m_compact(spark, d):
    database = _stored_orders(spark, d)
    database.compact()
    return database.read("orders").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"))


# collections


def nested_orders(spark, d) -> Node:
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("value"))
    return Node(Holder(df), Shape((KeyLevel("o_custkey", T.LongType()), KeyLevel("o_orderkey", T.LongType())), T.StringType()))


@query("SELECT DISTINCT o_custkey FROM orders")
def map_nested_level1(spark, d):
    return nested_orders(spark, d).keys()


@query("SELECT o_custkey, o_orderkey, o_orderstatus AS value FROM orders WHERE o_custkey >= 20")
def map_nested_leaves(spark, d):
    return nested_orders(spark, d).leaves(since=20)


@query("SELECT count(*) AS leaves FROM orders")
def map_nested_count(spark, d):
    return nested_orders(spark, d).leaves_count()


@query("SELECT o_orderkey, o_orderstatus AS value FROM orders WHERE o_custkey = 7")
def map_nested_at(spark, d):
    return nested_orders(spark, d).at(7).entries(reverse=True)


@query("SELECT o_custkey, o_orderkey, o_orderstatus AS value FROM orders WHERE o_custkey <> 7 UNION ALL VALUES (7, 1, 'Z')")
def map_nested_set(spark, d):
    node = nested_orders(spark, d)
    node.at(7).set({1: "Z"})
    return node.rows()


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_custkey = 8 THEN lower(o_orderstatus) ELSE o_orderstatus END AS value FROM orders""")
def map_replace_all(spark, d):
    node = nested_orders(spark, d)
    node.at(8).replace_all(lambda k, v: (k, F.lower(v)), can_keys_change=False)
    return node.rows()


def event_types(spark, d) -> Node:
    return stages.key_set(spark, KeyLevel("event_type", T.StringType()), df=table(spark, d, "events"))


@query("SELECT DISTINCT event_type FROM events")
def set_members(spark, d):
    return event_types(spark, d).key_set()


@query("SELECT DISTINCT event_type, 'before' AS side FROM events UNION ALL VALUES ('a', 'after'), ('b', 'after')")
def set_previous(spark, d):
    node = event_types(spark, d)
    before = node.set_key_set({"a", "b"})
    return before.withColumn("side", F.lit("before")).unionByName(node.key_set().withColumn("side", F.lit("after")))


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY user_id")
def counter_add(spark, d):
    none = spark.createDataFrame([], "key long, value long")
    return stages.add_all(none, table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit(1).cast("long").alias("value")))


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey = 0 THEN 9223372036854775807 ELSE -9223372036854775808 + n_nationkey - 1 END AS value FROM nation")
def counter_wrap(spark, d):
    big = F.lit(2**63 - 1)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), stages.wrapping_add(big, F.col("n_nationkey").cast("long")).alias("value"))


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY user_id")
def stream_counters(spark, d):
    """Counters kept by a stream of events, run to the end of what is there."""
    long_entry = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType())])
    database = MemoryDatabase(spark, "s", {"counters": long_entry, tables.PROGRESS: tables.PROGRESS_SCHEMA})
    path = f"{d}/events.parquet"
    # as a pattern, since a stream over a plain path takes a folder only
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/event[s].parquet")
    tables.count_into(stream, database, "counters", "events", F.col("user_id")).awaitTermination()
    return database.read("counters")


# codecs


@query("SELECT base64(unhex(format('{:016X}', o_orderkey))) AS key, base64(unhex('00000001') || encode(o_orderstatus)) AS value FROM orders")
def codec_b64_dump(spark, d):
    return byte_orders(spark, d).df.select(F.base64("key").alias("key"), F.base64("value").alias("value"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN '01' || format('{:016X}', o_orderkey) ELSE '02' || format('{:08X}', length(o_orderpriority)) || hex(encode(o_orderpriority)) END AS raw,
                 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS decoded FROM orders""")
def codec_versioned(spark, d):
    old = codecs.LONG.mapped(lambda v: v.cast("string"), lambda v: v.cast("bigint"))
    first, second = codecs.Versioned({1: old}, 1), codecs.Versioned({1: old, 2: codecs.TEXT}, 2)
    raw = F.when(F.col("o_orderkey") % 2 == 0, first.encode(F.col("o_orderkey").cast("string"))).otherwise(second.encode(F.col("o_orderpriority")))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), raw.alias("raw"))
    return held.select("key", F.hex("raw").alias("raw"), second.decode(F.col("raw")).alias("decoded"))


@query("SELECT n_nationkey AS key, upper(right(printf('%016x', n_nationkey - 12), 16)) AS long_hex, n_nationkey - 12 AS long_back, n_nationkey - 12 AS int_back FROM nation")
def codec_integers(spark, d):
    v = F.col("n_nationkey") - 12
    held = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), codecs.LONG.encode(v).alias("l"), codecs.INT.encode(v).alias("i"))
    return held.select("key", F.hex("l").alias("long_hex"), codecs.LONG.decode(F.col("l")).alias("long_back"), codecs.INT.decode(F.col("i")).alias("int_back"))


@query("SELECT p_partkey AS key, regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g') AS plain FROM part")
def codec_ascii(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), codecs.ascii_only(F.col("p_name")).alias("plain"))


# streams


@query("""WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events),
          r AS (SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY event_type, g)
          SELECT row_number() OVER (ORDER BY first) - 1 AS run, event_type, n, first, last FROM r""")
def stream_consecutive(spark, d):
    runs = streams.consecutive(table(spark, d, "events"), "event_type", ["event_id"])
    return runs.groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""WITH e AS (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS batch FROM events)
          SELECT batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY batch""")
def stream_batches(spark, d):
    chunks = streams.batches(table(spark, d, "events"), ["event_id"], 64)
    return chunks.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events")
def stream_indexed(spark, d):
    return streams.indexed(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "index")


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def stream_merge(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return streams.merge_ordered([a, b], ["key", "name"])


@query("""SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id <= e.event_id AND x.event_type = 'purchase')""")
def stream_while(spark, d):
    return streams.take_while(table(spark, d, "events"), F.col("event_type") != "purchase", ["event_id"], ["user_id"]).select("event_id", "user_id")


@query("""SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id < e.event_id AND x.event_type = 'purchase')""")
def stream_until(spark, d):
    return streams.take_until(table(spark, d, "events"), F.col("event_type") == "purchase", ["event_id"], ["user_id"]).select("event_id", "user_id")


@query("SELECT o_custkey, max(o_orderkey) AS folded FROM orders GROUP BY o_custkey")
def stream_fold(spark, d):
    return streams.fold(table(spark, d, "orders"), "o_orderkey", F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b), ["o_custkey"])


# search: numeric nodes


def on(spark, d, name: str, key: str, q: n.Query, *texts: str) -> DataFrame:
    return matches(text_index(table(spark, d, name), key, *texts), q)


@query("SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_size = 7")
def q_exact(spark, d):
    return on(spark, d, "part", "p_partkey", n.IntPointExactQuery("p_size", 7)).select("p_partkey", "score")


@query("SELECT event_id FROM events WHERE user_id = 3")
def q_long_term(spark, d):
    return on(spark, d, "events", "event_id", n.LongTermQuery("user_id", 3)).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_quantity BETWEEN 10 AND 20")
def q_range(spark, d):
    q = n.BooleanQuery(tuple(n.BooleanQueryPart(x, n.Occur.MUST) for x in (n.DoublePointRangeQuery("l_discount", 0.02, 0.04), n.DoublePointRangeQuery("l_quantity", 10.0, 20.0))))
    return on(spark, d, "lineitem", "l_orderkey", q).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def q_set(spark, d):
    return on(spark, d, "part", "p_partkey", n.IntPointSetQuery("p_size", (1, 5, 9))).select("p_partkey")


@query("SELECT doc_id, toxic FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE toxic IS NOT NULL")
def q_exists(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return matches(text_index(df, "doc_id"), n.FieldExistsQuery("toxic")).select("doc_id", "toxic")


@query("SELECT event_id, 1.0::DOUBLE AS score FROM events")
def q_all(spark, d):
    return on(spark, d, "events", "event_id", n.MatchAllDocsQuery()).select("event_id", "score")


@query("SELECT event_id FROM events WHERE false")
def q_none(spark, d):
    return on(spark, d, "events", "event_id", n.MatchNoDocsQuery()).select("event_id")


@query("""SELECT event_id FROM events WHERE (CAST(event_type = 'click' AS INT) + CAST(user_id < 50 AS INT) + CAST(value > 50 AS INT)) >= 2 AND event_id % 1 = 0 AND NOT user_id = 3""")
def q_bool_min_should(spark, d):
    should = [n.TermQuery(n.Term("event_type", "click")), n.LongPointRangeQuery("user_id", -(2**63), 49), n.DoublePointRangeQuery("value", 50.00000001, float("inf"))]
    built = [n.BooleanQueryPart(q, n.Occur.SHOULD) for q in should] + [n.BooleanQueryPart(n.LongPointExactQuery("user_id", 3), n.Occur.MUST_NOT)]
    return on(spark, d, "events", "event_id", n.BooleanQuery(tuple(built), 2)).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1::FLOAT AND 0.1::FLOAT AND embedding[2] BETWEEN 0::FLOAT AND 1::FLOAT")
def q_nd_range(spark, d):
    return on(spark, d, "embeddings", "vec_id", n.FloatNDPointRangeQuery("embedding", (-0.1, 0.0), (0.1, 1.0))).select("vec_id")


@query("SELECT e.vec_id FROM embeddings e WHERE e.embedding = (SELECT embedding FROM embeddings WHERE vec_id = 3)")
def q_nd_exact(spark, d):
    one = table(spark, d, "embeddings").where("vec_id = 3").first().embedding
    return on(spark, d, "embeddings", "vec_id", n.FloatNDPointExactQuery("embedding", tuple(one))).select("vec_id")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 8")
def q_doc_values_range(spark, d):
    return on(spark, d, "part", "p_partkey", n.SortedNumericDocValuesFieldSlowRangeQuery("p_size", 5, 8)).select("p_partkey")


# search: text nodes

_TOKENS = "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents"


def bm25_sql(*terms: str, boosts: dict[str, float] | None = None) -> str:
    """doc_id, score of documents with any of the terms."""
    listed = ", ".join(f"('{t}', {(boosts or {}).get(t, 1.0)}::DOUBLE)" for t in terms)
    return f"""
        WITH d AS ({_TOKENS}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d WHERE len(w) > 0), q(t, b) AS (VALUES {listed}),
        f AS (SELECT doc_id, t, b, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS dl FROM d, q), g AS (SELECT t, count(*) AS df FROM f WHERE tf > 0 GROUP BY t)
        SELECT doc_id, round(sum(b * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
        FROM f JOIN g USING (t), s WHERE tf > 0 GROUP BY doc_id"""


_indexes: dict[tuple, StoredIndex] = {}


def documents(spark, d) -> StoredIndex:
    """The index of documents, written once a session for a state of the files; postings with the first query that reads one."""
    df = table(spark, d, "documents")
    name = (spark.sparkContext.applicationId, d, tuple(sorted((f, modified(spark, f)) for f in df.inputFiles())))
    if name not in _indexes:
        _indexes[name] = write_documents(text_index(df, "doc_id", "text"), f"{shared_folder(spark)}/kvloom-index-{uuid.uuid4().hex}")
    return _indexes[name]


def scored(spark, d, q: n.Query) -> DataFrame:
    return matches(documents(spark, d), q, columns=["doc_id"]).select("doc_id", "score")


@query(f"""WITH d AS ({_TOKENS}) SELECT 'text' AS field, (SELECT count(*) FROM d WHERE len(w) > 0) AS documents, (SELECT sum(len(w))::BIGINT FROM d) AS length,
           (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM d)) AS terms""")
def q_index(spark, d):
    """What the stored index holds; the first text query of a session writes it."""
    index = documents(spark, d)
    held = spark.read.parquet(f"{index.inverted}/fields")
    return held.join(spark.read.parquet(f"{index.inverted}/terms").groupBy("field").agg(F.count(F.lit(1)).alias("terms")), "field")


def term(word: str, field: str = "text") -> n.TermQuery:
    return n.TermQuery(n.Term(field, word))


def any_of(*queries: n.Query) -> n.BooleanQuery:
    return n.BooleanQuery(tuple(n.BooleanQueryPart(q, n.Occur.SHOULD) for q in queries), 1)


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_contains(w, 'clown')")
def q_term(spark, d):
    return scored(spark, d, term("clown")).select("doc_id")


@query(bm25_sql("clown", "idiot"))
def q_term_bm25(spark, d):
    return scored(spark, d, any_of(term("clown"), term("idiot")))


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM ({_TOKENS})) WHERE contains(t, ' of the ')")
def q_phrase(spark, d):
    return scored(spark, d, n.PhraseQuery((n.TermPosition(n.Term("text", "of"), 0), n.TermPosition(n.Term("text", "the"), 1)))).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM ({_TOKENS})) WHERE regexp_matches(t, ' that( [^ ]+)? with ') OR contains(t, ' with that ')")
def q_phrase_slop(spark, d):
    # displacements of two terms: that x with (1), that with (0), with that (2) need slop 2; slop 2 also takes that x y with
    q = n.PhraseQuery((n.TermPosition(n.Term("text", "that"), 0), n.TermPosition(n.Term("text", "with"), 1)), 1)
    other = n.PhraseQuery((n.TermPosition(n.Term("text", "with"), 0), n.TermPosition(n.Term("text", "that"), 1)), 0)
    return scored(spark, d, any_of(q, other)).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM ({_TOKENS})) WHERE contains(t, ' and the ')")
def q_solr_text(spark, d):
    return scored(spark, d, n.SolrTextQuery("text", "And, the!", 0)).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE len(list_filter(w, lambda x: x LIKE 'wor%le_s')) > 0")
def q_wildcard(spark, d):
    return scored(spark, d, n.WildcardQuery("text", "wor*le?s")).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE len(list_filter(w, lambda x: abs(len(x) - 7) <= 1 AND left(x, 2) = 'wo' AND levenshtein(x, 'worhtle') <= 2)) > 0 OR len(list_filter(w, lambda x: left(x, 1) = 'c' AND abs(len(x) - 5) <= 1 AND damerau_levenshtein(x, 'clonw') <= 1)) > 0")
def q_fuzzy(spark, d):
    far = n.FuzzyQuery(n.Term("text", "worhtle"), 2, 2, 1000, False)
    swap = n.FuzzyQuery(n.Term("text", "clonw"), 1, 1, 1000, True)
    return scored(spark, d, any_of(far, swap)).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_any(w, ['moron', 'loser'])")
def q_synonym(spark, d):
    return scored(spark, d, n.SynonymQuery("text", (n.TermAndBoost(n.Term("text", "moron"), 1.0), n.TermAndBoost(n.Term("text", "loser"), 0.5)))).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) d JOIN documents o USING (doc_id) WHERE list_contains(w, 'clown') AND list_contains(w, 'idiot') AND NOT list_contains(w, 'scum') AND n_chars BETWEEN 100 AND 5000")
def q_standard(spark, d):
    q = n.StandardQuery("+clown AND idiot -scum +n_chars:[100 TO 5000]", ("text",), (n.PointConfig("n_chars", n.PointType.LONG),))
    return scored(spark, d, q).select("doc_id")


_MORE = f"""
    WITH d AS ({_TOKENS}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d WHERE len(w) > 0),
    p AS (SELECT t, count(*) AS tf FROM (SELECT unnest(w) AS t FROM d WHERE doc_id = 0) GROUP BY t HAVING count(*) >= 2),
    f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM p) GROUP BY ALL), g AS (SELECT t, count(*) AS df FROM f GROUP BY t),
    c AS (SELECT t, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM p JOIN g USING (t), s WHERE df >= 5 ORDER BY p.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) DESC, t LIMIT 10)
    SELECT doc_id, round(sum(idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))), 6) AS score
    FROM f JOIN c USING (t) JOIN d USING (doc_id), s WHERE doc_id <> 0 GROUP BY doc_id"""


@query(_MORE)
def q_more_like_this(spark, d):
    return scored(spark, d, n.MoreLikeThisQuery("0", ("text",), minTf=2, minDf=5, maxQt=10))


@query(f"SELECT doc_id, 1.0::DOUBLE AS score FROM ({_TOKENS}) WHERE list_contains(w, 'trash')")
def q_const_score(spark, d):
    return scored(spark, d, n.ConstantScoreQuery(term("trash")))


@query(bm25_sql("stupid", "trash", boosts={"stupid": 6.0}))
def q_boost(spark, d):
    return scored(spark, d, any_of(n.BoostQuery(n.BoostQuery(term("stupid"), 2.0), 3.0), n.BoxedQuery(n.FilterConfigQuery(term("trash"), True))))


@query("SELECT doc_id, round((n_chars * 2 + doc_id / 4.0) * 0.5, 6) AS score FROM documents")
def q_function(spark, d):
    return scored(spark, d, n.SolrFunctionQuery("sum(product(n_chars, 2), div(doc_id, 4))", 0.5))


# search: requests


@query("SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 5")
def s_numeric(spark, d):
    return search(documents(spark, d), n.QueryParams(term("de", "lang"), 5, 25, n.NumericSort("n_chars", True))).page


@query(f"SELECT * FROM ({bm25_sql('clown')}) ORDER BY score DESC, doc_id LIMIT 10")
def s_score(spark, d):
    return search(documents(spark, d), n.QueryParams(term("clown"), 0, 10)).page


@query("SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 12 OFFSET 3")
def s_doc(spark, d):
    return search(documents(spark, d), n.QueryParams(term("fr", "lang"), 3, 12, n.DocSort())).page


@query("SELECT doc_id FROM documents ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 20")
def s_random(spark, d):
    return search(documents(spark, d), n.QueryParams(n.MatchAllDocsQuery(), 0, 20, n.RandomSort("7"))).page


@query("""SELECT '' || (SELECT count(*) FROM documents WHERE lang = 'en') AS precise, CASE WHEN (SELECT count(*) FROM documents WHERE lang = 'en') >= 11 THEN '11+' ELSE '' || (SELECT count(*) FROM documents WHERE lang = 'en') END AS bounded""")
def s_hits_count(spark, d):
    q = term("en", "lang")
    precise = search(documents(spark, d), n.QueryParams(q, 0, 10)).total()
    bounded = search(documents(spark, d), n.QueryParams(q, 0, 10, computePreciseHitsCount=False)).total()
    return spark.createDataFrame([(str(precise), str(bounded))], "precise string, bounded string")


@query("SELECT doc_id, quality, toxic FROM (SELECT doc_id FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 30) LEFT JOIN labels USING (doc_id)")
def s_enriched(spark, d):
    return search(documents(spark, d), n.QueryParams(term("es", "lang"), 0, 30, n.DocSort())).enriched(table(spark, d, "labels"))


# analysis


@query("""SELECT conv_id, turn, g, count(*) AS n FROM (
            SELECT conv_id, turn, unnest(list_transform(range(2, least(4, len(t)) + 1), lambda k: left(t, k))) AS g
            FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM conversations) WHERE len(t) >= 2) GROUP BY ALL""")
def a_edge_ngram(spark, d):
    grams = text.edge_ngrams(text.tokens(F.col("text")), 2, 4)
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(grams).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, g, count(*) AS n FROM (
            SELECT conv_id, turn, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i : i + 2])) AS g
            FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM conversations) WHERE len(t) >= 3) GROUP BY ALL""")
def a_ngram(spark, d):
    grams = text.ngrams(text.tokens(F.col("text")), 3, 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(grams).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count(F.lit(1)).alias("n"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_STOP})), ' ') AS words FROM conversations")
def a_stopwords(spark, d):
    words = text.without_stop_words(text.tokens(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE 6371.0088 * 2 * asin(sqrt(pow(sin(radians(c_nationkey - 10) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(10)) * pow(sin(radians(c_custkey % 90 - 20) / 2), 2))) <= 900")
def a_coordinates(spark, d):
    return table(spark, d, "customer").where(text.within_km(F.col("c_nationkey"), F.col("c_custkey") % 90, 10.0, 20.0, 900.0)).select("c_custkey", "c_acctbal")


# the rest, by theme
from kvloom import queries_collections, queries_points, queries_store, queries_values  # noqa: E402, F401
