"""Dropped lines against a dictionary, by arrays and by the join beyond their bound."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kvloom.llm import line_dedup

LAST = 1 << 62


def expected(rows):
    docs, strip = {}, " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = LAST if i is None else i
        kept = [x for x in lines if len(key(x)) < 10 or len(docs[key(x)]) < 2 or min(docs[key(x)]) == me]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    pool = ["A common line here", "  a COMMON line here\t", "short", "ÀÉ common line", "àé common line", "exactly10!", "nine char", "", "日本語の長い行です。十", "x" * 5000]
    rows = [(i, "\n".join(r.choice([*pool, f"line {r.random()} of its own"]) for _ in range(r.randint(0, 9)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (None, "a common line here\nnull's own line here"), (None, "null's own line here"), (7, rows[7][1]), (7, "a second text of seven\n" + pool[0])]


@pytest.mark.parametrize("most_keys", [1000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_the_definition(spark, documents, seed, most_keys):
    rows = rows_of(seed)
    got = line_dedup.drop_repeated_lines(documents(rows), most_keys=most_keys).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected(rows)


@pytest.mark.parametrize(("most_keys", "heavy"), [(1000, 1), (0, 1), (0, 50), (0, 100_000)])
def test_several_shards(spark, documents, monkeypatch, most_keys, heavy):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rows = [(i, "\n".join(f"repeated line number {j}" for j in range(i % 7, 300, 1 + i % 5)) + "\na line in all texts" * 3) for i in range(40)]
    got = line_dedup.drop_repeated_lines(documents(rows), most_keys=most_keys).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected(rows)


def test_ids_of_another_type(spark):
    rows = [("b", "a line of both texts\nown line of b"), ("a", "A line of both texts"), (None, "a line of both texts")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for most_keys in (1000, 0):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(docs, most_keys=most_keys).collect()}
        assert got == {"b": (2, 1, "own line of b"), "a": (1, 0, "A line of both texts"), None: (1, 1, "")}


def test_keys_with_equal_first_halves():
    h1, h2 = np.full(3, 7, np.uint64), np.array([1, 2, 3], np.uint64)
    shards = line_dedup.Shards({0: line_dedup.pack_shard(h1, h2, np.array([10, 20, 30]), np.ones(3, np.int64))}, 0)
    assert shards.keepers(np.r_[h1, h1[:1]], np.r_[h2, np.uint64(9)]).tolist() == [10, 20, 30, -1]


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_many_lines_in_a_text(spark, documents, most_keys):
    long = "\n".join(f"line number {j} of a long text" for j in range(100_000))
    rows = [(1, "line number 77 of a long text"), (2, long), (3, long.upper() + "\nits own last line")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(documents(rows), most_keys=most_keys).collect()}
    assert got[1][:2] == (1, 0) and got[2] == (100_000, 1, long.replace("line number 77 of a long text\n", "", 1)) and got[3] == (100_001, 100_000, "its own last line")


def test_filter_passes_all_repeated_keys_and_few_others(spark):
    r = np.random.default_rng(4)
    keys = r.integers(-(2**63), 2**63, (20_000, 2))
    words = line_dedup._repeated_filter(spark.createDataFrame([tuple(map(int, k)) for k in keys], "h1 long, h2 long"), len(keys))
    assert line_dedup._may_hold(words, *np.ascontiguousarray(keys.T).view(np.uint64)).all()
    assert line_dedup._may_hold(words, *r.integers(0, 2**63, (2, 20_000)).astype(np.uint64)).mean() < 0.05


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 50_000, dtype=np.uint64))
    found = line_dedup.PerfectHash.build(keys)
    assert np.array_equal(np.sort(found.index(keys)), np.arange(len(keys)))


def test_empty_table(spark, documents):
    assert line_dedup.drop_repeated_lines(documents([])).count() == 0
