"""Registered queries of the collections: entries, maps, nested maps, hashed maps, sets, cells and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.operators import stages
from kvloom.operators.deltas import Returned, UpdateMode, is_changed, map_delta, resolve_delta
from kvloom.operators.stages import Cell, Holder, IntCounter, KeyLevel, LongCounter, Node, Shape
from kvloom.queries import nested_orders, query, table

_LONG, _TEXT = T.LongType(), T.StringType()


def nations(spark, d, mode: UpdateMode = UpdateMode.ALLOW) -> Node:
    """A flat map: nation name by key."""
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("value"))
    return stages.flat_map(spark, KeyLevel("k", _LONG), _TEXT, mode, df)


def regions(spark, d) -> Node:
    """A nested map: nation name by region and nation."""
    df = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("value"))
    return Node(Holder(df), Shape((KeyLevel("r", _LONG), KeyLevel("k", _LONG)), _TEXT))


def told(*frames: DataFrame) -> DataFrame:
    """(step, told): the single values of one-row results, as text; a result without a row is null."""
    rows = [f.toDF("told").agg(F.max(F.col("told").cast("string")).alias("told")).select(F.lit(i).alias("step"), "told") for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, rows)


def steps(*values: str) -> str:
    """SQL of told() with these SQL values."""
    return "SELECT step::INTEGER AS step, told FROM (VALUES " + ", ".join(f"({i}, CAST({v} AS VARCHAR))" for i, v in enumerate(values)) + ") s(step, told)"


def name(key: int) -> str:
    return f"(SELECT n_name FROM nation WHERE n_nationkey = {key})"


def every(df: DataFrame) -> DataFrame:
    return df.select("k", "value")


_NATIONS = "SELECT n_nationkey::BIGINT AS k, n_name AS value FROM nation"


# entries


@query(steps(name(3), "NULL"))
def entry_get(spark, d):
    m = nations(spark, d)
    return told(m.at(3).get(), m.at(77).get())


@query(steps(name(3), "'none'"))
def entry_get_or_default(spark, d):
    m = nations(spark, d)
    return told(m.at(3).get_or_default("none"), m.at(77).get_or_default("none"))


@query(steps("true", "false", "true"))
def entry_set_changed(spark, d):
    m = nations(spark, d)
    return told(*[m.at(3).set_and_get_changed(v) for v in ("new", "new", "newer")])


@query(f"{_NATIONS} WHERE k NOT IN (3, 4) UNION ALL VALUES (3, 'old!'), (77, 'made')")
def entry_update(spark, d):
    m = nations(spark, d)
    m.at(3).set("old")
    m.at(3).update(lambda v: F.concat(v, F.lit("!")))
    m.at(77).update(lambda v: F.coalesce(v, F.lit("made")))
    m.at(4).update(lambda v: F.lit(None))
    return every(m.rows())


@query(steps(name(5), "lower(" + name(5) + ")"))
def entry_update_returns(spark, d):
    m = nations(spark, d)
    return told(m.at(5).update(F.lower, Returned.OLD), m.at(5).update(F.lower, Returned.NEW))


@query(f"SELECT previous, current, previous IS DISTINCT FROM current AS changed FROM (SELECT {name(6)} AS previous, upper({name(6)}) || '.' AS current UNION ALL SELECT NULL, NULL)")
def entry_update_delta(spark, d):
    m = nations(spark, d)
    both = [m.at(k).update_and_get_delta(lambda v: F.concat(F.upper(v), F.lit("."))) for k in (6, 77)]
    return both[0].union(both[1]).select("delta.previous", "delta.current", "changed")


@query(steps("true", "false", name(8), "NULL"))
def entry_clear_status(spark, d):
    m = nations(spark, d)
    return told(m.at(7).clear_and_get_status(), m.at(7).clear_and_get_status(), m.at(8).clear_and_get_previous(), m.at(8).clear_and_get_previous())


@query(steps("25 + 0", "false", "true"))
def entry_is_empty(spark, d):
    m = nations(spark, d)
    return told(m.leaves_count(), m.at(3).is_empty(), m.at(77).is_empty())


@query("SELECT n_nationkey::BIGINT AS k, n_name AS value FROM nation WHERE n_nationkey = 9")
def entry_row(spark, d):
    return every(nations(spark, d).at(9).rows())


@query(steps("'4'", "'5'", "'5'", "'5'"))
def entry_mapped(spark, d):
    """A number seen through its text."""
    node = stages.flat_map(spark, KeyLevel("k", _LONG), _TEXT).at(1)
    view = node.mapped(lambda v: v.cast("int"), lambda v: v.cast("string"))
    view.set(4)
    return told(view.get(), view.update(lambda v: v + 1, Returned.NEW), view.get(), node.get())


# flat maps


@query(steps("true", "false"))
def map_contains(spark, d):
    m = nations(spark, d)
    return told(m.contains(3), m.contains(77))


@query(f"{_NATIONS} WHERE k <> 1 UNION ALL VALUES (1, 'one'), (77, 'more')")
def map_put(spark, d):
    m = nations(spark, d)
    m.put(1, "one")
    m.put(77, "more")
    return every(m.rows())


@query(steps(name(2), "'a'", "true", "false", "NULL"))
def map_put_returns(spark, d):
    m = nations(spark, d)
    return told(m.put_and_get_previous(2, "a"), m.put_and_get_previous(2, "b"), m.put_and_get_changed(2, "c"), m.put_and_get_changed(2, "c"), m.put_and_get_previous(78, "x"))


@query(f"SELECT pos::INTEGER AS pos, k::BIGINT AS k, k <> 4 AS changed, CASE WHEN k = 77 THEN '77' WHEN k = 4 THEN {name(4)} ELSE upper({name(5)}) || '5' END AS value FROM (VALUES (0, 5), (1, 77), (2, 4)) a(pos, k)")
def map_update_multi(spark, d):
    m = nations(spark, d)
    asked = m.update_multi([5, 77, 4], lambda k, v: F.when(k == 4, v).otherwise(F.concat(F.coalesce(F.upper(v), F.lit("")), k.cast("string"))))
    return asked.join(m.rows(), "k").select("pos", "k", "changed", "value")


@query(steps(name(2), "NULL", "true", "false", "23"))
def map_remove_returns(spark, d):
    m = nations(spark, d)
    first = [m.remove_and_get_previous(2), m.remove_and_get_previous(2), m.remove_and_get_status(3), m.remove_and_get_status(3)]
    return told(*first, m.leaves_count())


@query("SELECT pos::INTEGER AS pos, a.k::BIGINT AS k, n_name AS value FROM (VALUES (0, 4), (1, 77), (2, 4)) a(pos, k) LEFT JOIN nation ON n_nationkey = a.k")
def map_get_multi(spark, d):
    return nations(spark, d).get_multi([4, 77, 4])


@query(f"{_NATIONS} WHERE k > 2 UNION ALL VALUES (1, 'last'), (2, 'b')")
def map_put_multi(spark, d):
    m = nations(spark, d)
    m.put_multi([(0, None), (1, "first"), (2, "b"), (1, "last")])
    return every(m.rows())


@query("SELECT n_nationkey::BIGINT AS k, n_name AS v, n_name AS value FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 9")
def map_entries_keys_values(spark, d):
    m = nations(spark, d)
    keys = m.entries(low=5, high=9).select("k").join(m.keys(), "k")
    return keys.join(m.entries().withColumnRenamed("value", "v"), "k").join(m.values().withColumn("v", F.col("value")), "v").select("k", "v", "value")


@query("SELECT 1::BIGINT AS k, 'x' AS value")
def map_clear(spark, d):
    m = nations(spark, d)
    m.clear()
    m.put(1, "x")
    return every(m.rows())


@query(steps("'25'", "'2'", "true", "false", "'2'", "NULL"))
def map_whole(spark, d):
    m = nations(spark, d)
    size = lambda df: df.select(F.size("value"))
    before = size(m.set_and_get_previous({1: "a", 2: "b"}))
    return told(before, size(m.get()), m.set_and_get_changed({1: "a", 2: "c"}), m.set_and_get_changed({1: "a", 2: "c"}), size(m.clear_and_get_previous()), size(m.get()))


@query(steps("'25'", "'24'", "true", "'24'"))
def map_whole_delta(spark, d):
    m = nations(spark, d, UpdateMode.ALLOW_UNSAFE)
    got = m.update_and_get_delta(lambda old: F.map_filter(old, lambda k, _: k != 3))
    return told(got.select(F.size("delta.previous")), got.select(F.size("delta.current")), got.select("changed"), m.leaves_count())


@query("SELECT mode, mode <> 'disallow' AS updates, mode = 'allow_unsafe' AS whole_maps FROM (VALUES ('disallow'), ('allow'), ('allow_unsafe')) m(mode)")
def update_modes(spark, d):
    def allowed(mode: UpdateMode, of) -> bool:
        try:
            of(nations(spark, d, mode)).update_and_get_delta(lambda old: old)
        except PermissionError:
            return False
        return True

    rows = [(m.value, allowed(m, lambda x: x.at(1)), allowed(m, lambda x: x)) for m in UpdateMode]
    return spark.createDataFrame(rows, "mode string, updates boolean, whole_maps boolean")


@query("""SELECT o_orderkey AS key, a IS DISTINCT FROM b AS modified, lower(a) AS previous, lower(b) AS current, a AS old, b AS new
          FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, nullif(o_orderstatus, 'P') AS b FROM orders)""")
def delta_algebra(spark, d):
    status = F.col("o_orderstatus")
    pair = F.struct(F.nullif(status, F.lit("F")).alias("previous"), F.nullif(status, F.lit("P")).alias("current"))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), pair.alias("pair"))
    low = map_delta(F.col("pair"), F.lower)
    both = {"old": resolve_delta(F.col("pair"), Returned.OLD), "new": resolve_delta(F.col("pair"), Returned.NEW)}
    return held.select("key", is_changed(F.col("pair")).alias("modified"), low["previous"].alias("previous"), low["current"].alias("current"), *[c.alias(k) for k, c in both.items()])


# nested maps


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || '=' || o_orderstatus, ',' ORDER BY o_orderkey) AS joined FROM orders WHERE o_custkey IN (4, 7, 13) GROUP BY o_custkey")
def map_nested_maps(spark, d):
    """Whole maps of a level, through the nodes."""
    frames = []
    for key in (4, 7, 13):
        entries = F.map_entries("value")
        joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")
        frames.append(nested_orders(spark, d).at(key).get().select(F.lit(key).cast("long").alias("o_custkey"), F.size("value").cast("long").alias("n"), joined.alias("joined")))
    return reduce(DataFrame.unionByName, frames)


@query("SELECT n_regionkey::BIGINT AS r, count(*) AS leaves FROM nation GROUP BY 1")
def map_stages(spark, d):
    """The children of a nested map, one node each."""
    frames = [e.stage.leaves_count().select(F.lit(e.key).cast("long").alias("r"), "leaves") for e in regions(spark, d).stages()]
    return reduce(DataFrame.unionByName, frames)


@query("SELECT n_regionkey::BIGINT AS r, n_regionkey || '/' || n_nationkey || '/' || n_name AS merged FROM nation WHERE n_regionkey >= 2")
def map_leaves_merged(spark, d):
    return regions(spark, d).leaves(since=2, merge=lambda r, k, v: F.concat_ws("/", r, k, v))


@query("SELECT r::BIGINT AS r, k::BIGINT AS k, value FROM (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS value FROM nation) WHERE NOT (r = 1 AND k = 2) AND r <> 3 UNION ALL VALUES (9, 1, 'new')")
def map_nested_writes(spark, d):
    m = regions(spark, d)
    m.put_multi({(1, 2): None, (9, 1): "new"})
    m.at(3).clear()
    return m.rows().select("r", "k", "value")


# hashed maps and sets


def hashed_parts(spark, d, mode: UpdateMode = UpdateMode.ALLOW) -> stages.HashedMap:
    df = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("value"))
    return stages.hashed_map(spark, KeyLevel("name", _TEXT), _LONG, lambda k: F.length(k).cast("int"), T.IntegerType(), mode, df)


_HASHED = "SELECT length(p_name)::INTEGER AS hash, p_name AS name, min(p_partkey) AS value FROM part GROUP BY p_name"


@query(f"SELECT hash, count(*) AS n, string_agg(name || '=' || value, ',' ORDER BY name) AS joined FROM ({_HASHED}) GROUP BY hash")
def map_hashed_entries(spark, d):
    """The buckets themselves: their hash and their entries in order."""
    joined = F.array_join(F.transform("entries", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return hashed_parts(spark, d).buckets().select("hash", F.size("entries").cast("long").alias("n"), joined.alias("joined"))


@query(f"""WITH h AS ({_HASHED}), f AS (SELECT min(name) AS a, max(name) AS z FROM h)
          SELECT hash, name, CASE WHEN name = (SELECT a FROM f) THEN value + 1000 ELSE value END AS value FROM h WHERE name <> (SELECT z FROM f) UNION ALL VALUES (1, 'q', 5), (0, '', 6)""")
def map_hashed_writes(spark, d):
    m = hashed_parts(spark, d)
    row = m.entries().agg(F.min("name").alias("a"), F.max("name").alias("z")).first()
    m.put_multi({"q": 4, "": 6})
    m.put("q", 5)
    m.remove(row.z)
    m.at(row.a).update(lambda v: v + 1000)
    return m.node.rows().select("hash", "name", "value")


@query(f"SELECT name, value AS previous, value * 2 AS current, true AS changed FROM ({_HASHED}) WHERE name = (SELECT min(p_name) FROM part) UNION ALL VALUES ('no such name', NULL, NULL, false)")
def map_hashed_update(spark, d):
    m = hashed_parts(spark, d)
    first = m.entries().agg(F.min("name")).first()[0]
    return m.update([first, "no such name"], lambda _, v: v * 2)


@query(f"SELECT name, value FROM ({_HASHED}) WHERE hash = (SELECT min(length(p_name)) FROM part)")
def map_bucket(spark, d):
    """One bucket as a map of its own."""
    m = hashed_parts(spark, d)
    return m.bucket(m.node.rows().agg(F.min("hash")).first()[0]).entries().select("name", "value")


@query("SELECT DISTINCT event_type AS member FROM events WHERE event_type <> 'click' UNION ALL VALUES ('added')")
def set_hashed(spark, d):
    s = stages.hashed_set(spark, KeyLevel("event_type", _TEXT), df=table(spark, d, "events"))
    s.add("added", "view")
    s.discard("click", "never")
    return s.members().select(F.col("event_type").alias("member"))


# cells and counters


@query(steps("'7'", "'9'", "'7'", "'10'"))
def cell_values(spark, d):
    cells = stages.flat_map(spark, KeyLevel("name", _TEXT), _LONG)
    cell, seen = Cell.open(cells, "x", 7), []
    seen.append(cell.get())
    cell.set(9)
    seen.append(cell.get())
    cell.set(None)
    seen.append(cell.get())
    seen.append(cell.update(lambda v: F.coalesce(v, F.lit(9)) + 1, Returned.NEW))
    return told(*seen)


@query(steps("'5'", "'5'", "'4'", "'4'", "'-9223372036854775808'"))
def counter_long(spark, d):
    c = LongCounter.open(stages.flat_map(spark, KeyLevel("name", _TEXT), _LONG), "n")
    seen = [c.add_and_get(5), c.get_and_decrement(), c.get_and_increment()]
    seen.append(c.decrement_and_get())
    c.set(2**63 - 1)
    return told(*seen, c.increment_and_get())


@query(steps("'2147483647'", "'-2147483648'", "'-2147483648'", "'2147483647'"))
def counter_int(spark, d):
    c = IntCounter.open(stages.flat_map(spark, KeyLevel("name", _TEXT), T.IntegerType()), "n", 2**31 - 2)
    return told(c.increment_and_get(), c.increment_and_get(), c.get_and_decrement(), c.get())
