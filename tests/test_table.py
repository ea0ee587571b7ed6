"""Tables of entries against a dictionary."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvloom.functions.ranges import KeyRange
from kvloom.operators.deltas import Result, Returned, UpdateMode, delta, is_changed, map_delta, resolve_delta
from kvloom.operators.table import KVTable, deltas_between


def make(spark, held, mode=UpdateMode.ALLOW):
    return KVTable(spark.createDataFrame(list(held.items()), "key long, value string"), mode=mode)


def state(table):
    return {r.key: r.value for r in table.df.collect()}


keys = st.integers(0, 6)
step = st.one_of(
    st.tuples(st.just("put"), st.lists(st.tuples(keys, st.one_of(st.none(), st.sampled_from("ab"))), min_size=1, max_size=3)),
    st.tuples(st.just("remove"), st.lists(keys, min_size=1, max_size=2)),
    st.tuples(st.just("update"), st.lists(keys, min_size=1, max_size=3)),
    st.tuples(st.just("clear"), st.tuples(keys, keys)),
    st.tuples(st.just("first"), st.none()),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(keys, st.sampled_from("abc"), max_size=5), st.lists(step, min_size=1, max_size=3))
def test_writes_equal_a_dictionary(spark, held, steps):
    table, model = make(spark, held), dict(held)
    for kind, given_ in steps:
        if kind == "put":
            table = table.put_multi(given_).table
            model |= dict(given_)
            model = {k: v for k, v in model.items() if v is not None}
        elif kind == "remove":
            table = table.remove(given_).table
            model = {k: v for k, v in model.items() if k not in given_}
        elif kind == "update":
            table = table.update(lambda v: F.when(v.isNull(), "n").when(v == "a", None).otherwise(F.concat(v, F.lit("+"))), given_).table
            new = {k: "n" if model.get(k) is None else None if model[k] == "a" else model[k] + "+" for k in given_}
            model = {k: v for k, v in (model | new).items() if v is not None}
        elif kind == "clear":
            low, high = sorted(given_)
            table = table.clear(KeyRange.of(low, high)).table
            model = {k: v for k, v in model.items() if not low <= k < high}
        else:
            table = table.remove_first().table
            model.pop(min(model, default=None), None)
    assert state(table) == model


def test_results_of_writes(spark):
    t = make(spark, {1: "a", 2: "b"})
    assert {r.key: r.previous for r in t.put_multi([(1, "x"), (9, "y")], Result.PREVIOUS).result.collect()} == {1: "a", 9: None}
    assert {r.key: r.existed for r in t.remove([1, 9], Result.EXISTED).result.collect()} == {1: True, 9: False}
    assert t.put(1, "z").result is None
    got = t.update_delta(lambda v: F.upper(v), [1, 9]).result.collect()
    assert {r.key: (r.delta.previous, r.delta.current, r.changed) for r in got} == {1: ("a", "A", True), 9: (None, None, False)}
    assert {r.key: r.value for r in t.update(lambda v: F.upper(v), [2], Returned.OLD).result.collect()} == {2: "b"}
    assert {r.key: r.value for r in t.update(lambda v: F.upper(v), [2], Returned.NEW).result.collect()} == {2: "B"}


def test_updates_are_gated_and_puts_are_not(spark):
    t = make(spark, {1: "a"}, UpdateMode.DISALLOW)
    with pytest.raises(PermissionError):
        t.update(lambda v: v, [1])
    assert state(t.put(1, "b").table) == {1: "b"}


def test_set_range_checks_its_keys(spark):
    t = make(spark, {1: "a", 5: "b", 9: "c"})
    assert state(t.set_range(KeyRange.of(4, 8), [(6, "x")]).table) == {1: "a", 6: "x", 9: "c"}
    with pytest.raises(Exception, match="outside the range"):
        t.set_range(KeyRange.of(4, 8), [(8, "x")]).table.df.collect()


def test_replace_range(spark):
    t = make(spark, {1: "a", 5: "b", 6: "c", 9: "d"})
    assert state(t.replace_range(KeyRange.of(5, 8), lambda k, v: (k + 10, F.upper(v))).table) == {1: "a", 15: "B", 16: "C", 9: "d"}
    assert state(t.replace_range(KeyRange.of(5, 8), lambda k, v: (F.lit(9).cast("long"), v)).table) == {1: "a", 9: "c"}
    assert state(t.replace_range(KeyRange.of(5, 8), lambda k, v: (k + 10, F.when(k == 5, v)), can_keys_change=False).table) == {1: "a", 5: "b", 9: "d"}


def test_reads(spark):
    t = make(spark, {k: str(k) for k in (5, 1, 9, 3)})
    assert [r.key for r in t.scan(KeyRange.of(1, 9)).collect()] == [1, 3, 5]
    assert [r.key for r in t.scan(KeyRange.of(1, 9), reverse=True).collect()] == [5, 3, 1]
    assert [(r.pos, r.key, r.value) for r in t.get_multi([9, 2, 9]).collect()] == [(0, 9, "9"), (1, 2, None), (2, 9, "9")]
    assert t.size(KeyRange.single(3)).first().size == 1 and t.first(KeyRange.single(3)).first().key == 3
    assert t.first_key(KeyRange.since(4)).first().key == 5 and t.is_empty(KeyRange.until(1)).first().is_empty
    assert t.contains(9).first().contains and t.get(4).count() == 0 and t.approximate_size().first().size == 4
    assert t.partitioned(3).count() == 4


def test_byte_groups_are_ordered(spark):
    t = KVTable(spark.createDataFrame([(b"\x80a", b"1"), (b"\x00b", b"2"), (b"\x00a", b"3"), (b"", b"4")], "key binary, value binary"))
    assert [(bytes(r.prefix), [bytes(e.value) for e in r.entries]) for r in t.grouped(1).collect()] == [(b"\x00", [b"3", b"2"]), (b"\x80", [b"1"])]
    assert [bytes(r.prefix) for r in t.prefixes(1).collect()] == [b"\x00", b"\x80"]
    assert [[bytes(k) for k in r["keys"]] for r in t.grouped_keys(1, KeyRange.prefix(b"\x00")).collect()] == [[b"\x00a", b"\x00b"]]


def test_deltas(spark):
    df = spark.createDataFrame([("a", None), ("a", "a"), (None, None)], "p string, c string").select(delta(F.col("p"), F.col("c")).alias("d"))
    assert [r.x for r in df.select(is_changed(F.col("d")).alias("x")).collect()] == [True, False, False]
    assert [tuple(r.x) for r in df.select(map_delta(F.col("d"), F.upper).alias("x")).collect()] == [("A", None), ("A", "A"), (None, None)]
    assert [r.x for r in df.select(resolve_delta(F.col("d"), Returned.NEW).alias("x")).collect()] == [None, "a", None]
    a, b = make(spark, {1: "a", 2: "b"}), make(spark, {2: "c", 3: "d"})
    assert {r.key: (r.previous, r.current) for r in deltas_between(a, b).collect()} == {1: ("a", None), 2: ("b", "c"), 3: (None, "d")}


def test_key_filters_reach_the_scan(spark, tmp_path):
    make(spark, {1: "a", 2: "b"}).df.write.parquet(str(tmp_path / "t"))
    plan = KVTable(spark.read.parquet(str(tmp_path / "t"))).scan_keys(KeyRange.of(1, 2))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,1), LessThan(key,2)" in plan and "ReadSchema: struct<key:bigint>" in plan
