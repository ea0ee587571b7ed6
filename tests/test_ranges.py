"""Ranges of keys: intersections, prefixes, predicates, text forms."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kvloom.functions.ranges import FileRange, KeyRange, first_key, next_key, successor

A, S, O = KeyRange.all(), lambda x: KeyRange.single(bytes([x])), lambda x, y: KeyRange.of(bytes([x]), bytes([y]))  # noqa: E741

#: Fixed values: (expected, a, b).
INTERSECTIONS = [
    (A, A, A), (S(1), S(1), A), (S(1), A, S(1)), (None, S(1), S(2)), (None, O(1, 2), O(2, 3)), (S(1), S(1), O(1, 2)), (S(1), O(1, 2), S(1)), (None, S(2), O(1, 2)),
    (None, O(1, 2), S(2)), (None, O(1, 2), O(3, 4)), (O(1, 2), O(1, 2), O(1, 3)), (O(4, 7), O(1, 7), O(4, 9)), (O(1, 2), O(1, 2), O(1, 2)),
]


@pytest.mark.parametrize(("expected", "a", "b"), INTERSECTIONS)
def test_intersections(expected, a, b):
    assert a.intersect(b) == expected


def test_half_open_intersections():
    assert KeyRange.since(3).intersect(KeyRange.until(7)) == KeyRange.of(3, 7)
    assert KeyRange.since(3).intersect(KeyRange.until(3)) is None
    assert KeyRange.since(3).intersect(A) == KeyRange.since(3)


def test_singles_are_compared_by_key():
    assert KeyRange.single(1) != KeyRange.single(2) and KeyRange.single(1) != A
    assert not KeyRange.single(1).encloses(KeyRange.single(2))


bound = st.one_of(st.none(), st.integers(0, 8))


def a_range(x, y, one):
    if one and x is not None:
        return KeyRange.single(x)
    return KeyRange(x, y) if x is None or y is None or x <= y else KeyRange(y, x)


@given(bound, bound, st.booleans(), bound, bound, st.booleans())
def test_ranges_equal_sets(a, b, c, d, e, f):
    x, y = a_range(a, b, c), a_range(d, e, f)
    common = [k for k in range(-1, 10) if k in x and k in y]
    both = x.intersect(y)
    assert [k for k in range(-1, 10) if both is not None and k in both] == common
    if x.encloses(y):
        assert all(k in x for k in range(-1, 10) if k in y)


@pytest.mark.parametrize("prefix", [b"\0\0\0", b"\0\0\1", b"\0\0\2", b"\0\1\2", b"\0\0\xff", b"\0\1\xff", b"\0\xff\xff", b"\xff\0\xff", b"\xff\xff\0"])
def test_next_prefix(prefix):
    assert int.from_bytes(next_key(prefix, 13)[:3], "big") == int.from_bytes(prefix, "big") + 1
    assert next_key(prefix, 13)[3:] == bytes(10)
    assert first_key(prefix, 13) == prefix + bytes(10)


def test_last_prefix():
    assert next_key(b"\xff\xff\xff", 13) == b"\xff" * 13 + b"\0"
    assert successor(b"\xff\xff") is None and successor(b"") is None


@given(st.binary(max_size=3), st.binary(max_size=5))
def test_prefix_ranges(prefix, key):
    assert (key in KeyRange.prefix(prefix)) == key.startswith(prefix)


def test_predicates(spark):
    df = spark.range(10)
    for r in (A, KeyRange.since(4), KeyRange.until(4), KeyRange.single(4), KeyRange.of(2, 5)):
        assert [x.id for x in df.where(r.predicate("id")).collect()] == [k for k in range(10) if k in r]


def test_bad_ranges():
    with pytest.raises(ValueError):
        KeyRange.of(2, 1)
    with pytest.raises(ValueError):
        KeyRange.single(None)


def test_split_covers_everything():
    parts = A.split(257, 2)
    assert parts[0].min is None and parts[-1].max is None
    assert all(a.max == b.min for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("text", ["none", "full", "offset-3-9", "offset--9", "offset-3-", "key-00ff-0102", "key--01", "key-01-", "single-key-00ff"])
def test_file_ranges_read_back(text):
    assert str(FileRange.parse(text)) == text


def test_bad_file_range():
    with pytest.raises(ValueError):
        FileRange.parse("some-key")
