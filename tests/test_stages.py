"""Collections: maps, nested maps, sets, cells, counters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.operators import stages
from kvloom.operators.deltas import Returned, UpdateMode
from kvloom.operators.stages import Cell, KeyLevel, LongCounter

BIG = "long value, " * 2000


def flat(spark, mode=UpdateMode.ALLOW):
    return stages.flat_map(spark, KeyLevel("k", T.StringType(), 5), T.StringType(), mode)


def deep(spark, mode=UpdateMode.ALLOW):
    return stages.nested_map(spark, [KeyLevel("k1", T.StringType(), 5), KeyLevel("k2", T.StringType(), 6)], T.StringType(), mode)


def value(df):
    row = df.first()
    return row and row[0]


@pytest.mark.parametrize("key", ["", "kiwi", "banana"])
def test_bad_keys(spark, key):
    with pytest.raises(ValueError):
        flat(spark).put(key, "x")
    with pytest.raises(ValueError):
        deep(spark).at(key)


@pytest.mark.parametrize("new", ["", "\0", BIG])
def test_previous_values_and_status(spark, new):
    m = flat(spark)
    assert value(m.put_and_get_previous("mango", "first")) is None
    assert value(m.put_and_get_previous("mango", new)) == "first"
    assert value(m.remove_and_get_previous("mango")) == new
    assert value(m.remove_and_get_previous("mango")) is None
    assert [value(m.remove_and_get_status("mango")), m.put("mango", new), value(m.remove_and_get_status("mango")), value(m.remove_and_get_status("mango"))] == [False, None, True, False]


def test_changed_flags(spark):
    m = flat(spark)
    assert [value(m.put_and_get_changed("mango", v)) for v in ("p", "q", "q", "r", "r")] == [True, True, False, True, False]
    updates = ["p", "q", "q", "q", "r"]
    got = [value(m.at("olive").update_and_get_delta(lambda _, v=v: F.lit(v)).select("changed")) for v in updates]
    assert got == [True, True, False, False, True]


def test_updates(spark):
    m = flat(spark)
    assert value(m.at("mango").update(lambda old: F.coalesce(old, F.lit("new")), Returned.NEW)) == "new"
    assert value(m.at("mango").update(lambda old: F.concat(old, F.lit("!")), Returned.OLD)) == "new"
    assert value(m.at("mango").get()) == "new!"
    m.at("mango").update(lambda _: F.lit(None))
    assert m.at("mango").get().count() == 0 and value(m.is_empty())
    with pytest.raises(PermissionError):
        flat(spark, UpdateMode.DISALLOW).at("mango").update(lambda old: old)


def test_bulk(spark):
    m = flat(spark)
    m.put_multi({"mango": "a", "olive": "b"})
    assert [(r.pos, r.k, r.value) for r in m.get_multi(["olive", "peach", "mango"]).collect()] == [(0, "olive", "b"), (1, "peach", None), (2, "mango", "a")]
    got = m.update_multi(["mango", "peach"], lambda k, old: F.coalesce(F.upper(old), k)).orderBy("pos").collect()
    assert [r.changed for r in got] == [True, True]
    assert value(m.get()) == {"mango": "A", "olive": "b", "peach": "peach"}
    m.put_multi([("mango", "x"), ("mango", None)])
    assert value(m.contains("mango")) is False


def test_whole_maps(spark):
    m = flat(spark)
    assert m.get().count() == 0 and value(m.set_and_get_changed({})) is False
    assert value(m.set_and_get_changed({"mango": "a"})) is True and value(m.set_and_get_changed({"mango": "a"})) is False
    assert value(m.set_and_get_previous({"olive": "b"})) == {"mango": "a"}
    assert [tuple(r) for r in m.set_all_and_get_previous({"peach": "c"}).collect()] == [("olive", "b")]
    assert value(m.clear_and_get_previous()) == {"peach": "c"} and m.get().count() == 0
    with pytest.raises(PermissionError):
        m.update_and_get_delta(lambda old: old)
    unsafe = flat(spark, UpdateMode.ALLOW_UNSAFE)
    unsafe.set({"mango": "a"})
    got = unsafe.update_and_get_delta(lambda old: F.map_concat(old, F.create_map(F.lit("olive"), F.lit("b")))).first()
    assert got.delta.previous == {"mango": "a"} and got.changed and value(unsafe.get()) == {"mango": "a", "olive": "b"}


def test_nested_maps(spark):
    m = deep(spark)
    m.at("mango").put("carrot", "a")
    m.at("mango").put("turnip", "z")
    m.at("quail").set({"carrot": "quiet"})
    assert [tuple(r) for r in m.leaves().collect()] == [("mango", "carrot", "a"), ("mango", "turnip", "z"), ("quail", "carrot", "quiet")]
    assert [r.k1 for r in m.keys().collect()] == ["mango", "quail"] and value(m.leaves_count()) == 3 and value(m.at("mango").leaves_count()) == 2
    assert value(m.at("mango").get()) == {"carrot": "a", "turnip": "z"}
    assert [tuple(r) for r in m.at("mango").entries(low="d", reverse=True).collect()] == [("turnip", "z")]
    assert [tuple(r) for r in m.leaves(since="n").collect()] == [("quail", "carrot", "quiet")]
    before = m.holder.snapshot()
    m.at("mango").replace_all(lambda k, v: (F.reverse(k), F.upper(v)))
    assert value(m.at("mango").get()) == {"torrac": "A", "pinrut": "Z"}
    m.at("mango").clear()
    assert value(m.leaves_count()) == 1 and value(m.leaves_count(before)) == 3 and value(m.at("mango").is_empty()) and not value(m.at("mango").is_empty(before))
    assert [value(m.at("quail").at("carrot").update_and_get_delta(lambda _, v=v: F.lit(v)).select("changed")) for v in ("p", "p", "q", "p")] == [True, False, True, True]


def test_hashed_maps_take_keys_of_any_length(spark):
    m = stages.nested_map(spark, [KeyLevel("k1", T.StringType(), 5), KeyLevel("k2", T.StringType())], T.StringType())
    for k in ("", "x", "peach", "apricots"):
        m.at("mango").put(k, "v" + k)
    assert value(m.leaves_count()) == 4
    m.at("mango").set_all({"b": "1"})
    assert value(m.at("mango").get()) == {"b": "1"}
    table = stages.hashed(m.rows().select(F.col("k2").alias("key"), "value"), "key", lambda k: F.length(k).cast("short"))
    assert [(r.hash, [tuple(e) for e in r.entries]) for r in stages.buckets(table, "key", "value").collect()] == [(1, [("b", "1")])]


def hashed(spark, hash_fn=lambda k: F.length(k).cast("short")):
    return stages.hashed_map(spark, KeyLevel("k", T.StringType()), T.StringType(), hash_fn, T.ShortType())


def test_hashed_maps_write_by_bucket(spark):
    m = hashed(spark)
    m.put_multi({"ab": "1", "cd": "2", "e": "3"})
    assert [(r.hash, [tuple(e) for e in r.entries]) for r in m.buckets().orderBy("hash").collect()] == [(1, [("e", "3")]), (2, [("ab", "1"), ("cd", "2")])]
    assert value(m.get("cd")) == "2" and value(m.bucket(2).get()) == {"ab": "1", "cd": "2"}
    assert value(m.at("cd").set_and_get_previous("9")) == "2" and value(m.get("cd")) == "9" and value(m.get("ab")) == "1"
    assert value(m.at("cd").update(lambda old: F.concat(old, F.lit("!")), Returned.NEW)) == "9!"
    got = m.update(["ab", "zz"], lambda k, old: F.coalesce(F.upper(F.concat(k, old)), F.lit("new"))).collect()
    assert {(r.k, r.previous, r.current, r.changed) for r in got} == {("ab", "1", "AB1", True), ("zz", None, "new", True)}
    m.remove("ab")
    m.put("cd", None)
    assert {tuple(r) for r in m.entries().collect()} == {("e", "3"), ("zz", "new")} and not value(m.contains("ab")) and value(m.count()) == 2
    m.set_all({"q": "1"})
    assert [tuple(r) for r in m.entries().collect()] == [("q", "1")]
    m.clear()
    assert value(m.count()) == 0


def test_hashed_sets(spark):
    s = stages.hashed_set(spark, KeyLevel("k", T.StringType()), df=spark.createDataFrame([("a",), ("bb",), ("a",)], "k string"))
    s.add("ccc", "a")
    s.discard("bb", "none")
    assert {r.k for r in s.members().collect()} == {"a", "ccc"} and value(s.contains("ccc")) and not value(s.contains("bb"))
    assert {r.k for r in s.set_members({"x"}).collect()} == {"a", "ccc"} and [r.k for r in s.members().collect()] == ["x"] and value(s.count()) == 1


def test_stages_and_merged_leaves(spark):
    m = deep(spark)
    m.put_multi({("mango", "carrot"): "1", ("mango", "turnip"): "2", ("quail", "carrot"): "3"})
    assert [(e.key, value(e.stage.leaves_count())) for e in m.stages()] == [("mango", 2), ("quail", 1)]
    got = m.leaves(since="n", merge=lambda k1, k2, v: F.concat_ws("/", k1, k2, v)).collect()
    assert [tuple(r) for r in got] == [("quail", "quail/carrot/3")]


def test_sets(spark):
    s = stages.key_set(spark, KeyLevel("k", T.StringType()))
    assert s.set_key_set({"b", "a"}).count() == 0
    assert [r.k for r in s.set_key_set(["c"]).collect()] == ["a", "b"] and [r.k for r in s.clear_key_set().collect()] == ["c"]
    assert value(s.is_empty())


def cells(spark, type_):
    return stages.flat_map(spark, KeyLevel("k", T.StringType()), type_)


@pytest.mark.parametrize("number", [-(2**63), -(2**40) - 5, -77, -1, 0, 3, 255, 65536, 2**63 - 1])
def test_cells(spark, number):
    m = cells(spark, T.LongType())
    cell = Cell.open(m, "x", number)
    assert value(cell.get()) == number
    cell.set(5)
    assert value(cell.get()) == 5 and value(Cell.open(m, "x", 1).get()) == 5
    cell.set(None)
    assert value(cell.get()) == number


def test_counters(spark):
    c = LongCounter.open(cells(spark, T.LongType()), "n")
    assert value(c.get_and_add(5)) == 0 and value(c.add_and_get(2)) == 7 and value(c.increment_and_get()) == 8
    assert value(c.get_and_decrement()) == 8 and value(c.decrement_and_get()) == 6 and value(c.get_and_increment()) == 6
    c.set(2**63 - 1)
    assert value(c.increment_and_get()) == -(2**63)


def test_mapped_views(spark):
    m = cells(spark, T.StringType())
    view = m.at("x").mapped(lambda v: v.cast("int"), lambda v: v.cast("string"))
    view.set(41)
    assert value(view.update(lambda v: v + 1, Returned.NEW)) == 42 and value(m.at("x").get()) == "42" and value(view.get()) == 42
