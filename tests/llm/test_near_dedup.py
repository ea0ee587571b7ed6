"""Near-duplicate groups against brute force over all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kvloom.llm import near_dedup
from kvloom.llm.near_dedup import signatures, similarity, weights_of

WORD = re.compile(r"[^\W_]+")


def shingles(text: str) -> dict[tuple, float]:
    words = WORD.findall((text or "").lower())
    found = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return {k: 1 + math.log(n) for k, n in Counter(found).items()}


def probability_jaccard(a: dict, b: dict) -> float:
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())


def brute_groups(rows: list[tuple[int, str]], threshold: float = 0.8) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < 0.4 * max(len(a), len(b)) or not a.keys() & b.keys():
                continue
            if probability_jaccard(a, b) >= threshold:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_similarity_is_the_probability_jaccard():
    r = random.Random(3)
    for _ in range(200):
        a = {i: 1 + math.log(r.randint(1, 4)) for i in r.sample(range(30), r.randint(1, 20))}
        b = {i: 1 + math.log(r.randint(1, 4)) for i in r.sample(range(30), r.randint(1, 20))}
        x, y = sorted(a), sorted(b)
        got = similarity(np.array(x, np.uint64), np.array([a[i] for i in x]), np.array(y, np.uint64), np.array([b[i] for i in y]))
        assert got == pytest.approx(probability_jaccard(a, b))


def test_slots_agree_with_the_probability_jaccard():
    r = np.random.default_rng(5)
    names = r.integers(1, 2**63, 400).astype(np.uint64)
    a, b = names[:300], names[60:400]
    u, v = weights_of(r.integers(1, 5, 300)), weights_of(r.integers(1, 5, 340))
    row = np.r_[np.zeros(300, np.int64), np.ones(340, np.int64)]
    s = signatures(row, np.r_[a, b], np.r_[u, v], 2, 8000)
    p, q = np.argsort(a), np.argsort(b)
    assert (s[0] == s[1]).mean() == pytest.approx(similarity(a[p], u[p], b[q], v[q]), abs=0.025)


def planted() -> list[tuple[int, str]]:
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows: list[tuple[int, str]] = []
    passage = " ".join(word() for _ in range(60))
    for base in range(12):
        words = [word() for _ in range(r.choice([6, 40, 150, 400]))]
        for copy in range(r.choice([1, 2, 25])):
            w = list(words)
            for _ in range(copy % 4 * len(w) // 100):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 7 % 997 + 1000 * base, " ".join(w) + (" " + passage if base % 3 == 0 else "")))
    return rows


def test_groups_equal_brute_force(spark, documents):
    rows = planted() + [(90001, ""), (90002, "!!"), (90004, "one two"), (90005, "One, two"), (90006, "word " * 20000)]
    got = {r.doc_id: r for r in near_dedup.near_groups(documents(rows)).collect()}
    assert {i: r.group_id for i, r in got.items()} == brute_groups(rows)
    sizes = Counter(r.group_id for r in got.values())
    assert all(r.group_size == sizes[r.group_id] and r.kept == (r.doc_id == r.group_id) for r in got.values())


def test_filter_keeps_one_of_each_group_and_all_columns(spark, documents):
    docs = documents([*planted(), (None, None), (None, "alone in the whole wide world"), (77777, None)])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = brute_groups(planted())
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id != 77777) == sorted(set(groups.values()))
    assert kept.where("doc_id is null").count() == 2


def large_links(spark, slots, bands, shared):
    """The links of two nodes with the given slots, bands and shared shingles (of 100 each) that the blockwise comparison lets out."""
    nodes = spark.createDataFrame([(i + 1, bytearray(s.astype(np.uint8).tobytes()), b) for i, (s, b) in enumerate(zip(slots, bands, strict=True))], "node long, slots binary, bands array<long>")
    lists = spark.createDataFrame([(1, list(range(100)), []), (2, list(range(100 - shared, 200 - shared)), [])], "node long, s array<long>, n array<int>")
    members = [(b[p], p, i + 1, i + 1, 2) for i, b in enumerate(bands) for p in range(near_dedup.BANDS) if bands[0][p] == bands[1][p]]
    counted = spark.createDataFrame(members, "band long, place int, node long, component long, rows long")
    return [(r.a, r.b) for r in near_dedup._large_links(counted, nodes, lists, 0.8).collect()]


def test_slots_that_agree_by_chance_hide_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    a = np.arange(near_dedup.POSITIONS)
    b = a.copy()
    b[near_dedup.POSITIONS - 30 :] += 1  # bands 0 to 25 agree in all bytes, but the hashes only in band 5
    bands = [list(range(1, 31)), [6 if p == 5 else 100 + p for p in range(30)]]
    assert large_links(spark, [a, b], bands, 95) == [(1, 2)]


def test_only_pairs_beyond_doubt_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    a = np.arange(near_dedup.POSITIONS)
    bands = [list(range(1, 31)), [1] + [100 + p for p in range(1, 30)]]
    for agree, shared, out in ((150, 95, [(1, 2)]), (135, 95, [(1, 2)]), (120, 95, []), (150, 85, [])):  # 85 of 115 is under the threshold
        b = np.where(a < agree, a, a + 1)
        assert large_links(spark, [a, b], bands, shared) == out


def test_large_bands_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "PASSES", 1)
    rows = planted()
    assert {r.doc_id: r.group_id for r in near_dedup.near_groups(documents(rows)).collect()} == brute_groups(rows)


def drifting(n: int, seed: int) -> list[tuple[int, str]]:
    """Copies of a few texts that drift away from them, most pairs near the threshold; all of a text share bands."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(3):
        words = [word() for _ in range(120)]
        for _ in range(n):
            w = list(words)
            for _ in range(r.choice([1, 2, 2, 3, 3, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("small", "block", "passes"), [(32, 512, 3), (2, 8, 1)])
def test_recall_of_links_in_open_bands(spark, documents, monkeypatch, small, block, passes):
    """Links of brute force whose two texts come out in one group: nine of ten at least, and none that brute force has not."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PASSES", passes)
    rows = drifting(25, 7)
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(documents(rows)).collect()}
    sets, want = {i: shingles(t) for i, t in rows}, brute_groups(rows)
    links = [(i, j) for i, _ in rows for j in range(i) if i // 25 == j // 25 and probability_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(links) > 60 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    assert all(want[i] == want[g] for i, g in got.items())


def test_nodes_of_one_name_are_told_apart(spark, documents, monkeypatch):
    sketch = near_dedup.sketch_documents
    monkeypatch.setattr(near_dedup, "sketch_documents", lambda *a: sketch(*a).selectExpr("doc_id", "body", "node % 3 as node", "twin", "bands", "slots"))
    rows = planted()
    assert {r.doc_id: r.group_id for r in near_dedup.near_groups(documents(rows)).collect()} == brute_groups(rows)


def test_verified_links_are_a_lower_bound(spark, documents):
    rows = planted()
    sets = {i: frozenset(shingles(t).items()) for i, t in rows}
    different = {s: dict(s) for s in set(sets.values())}
    got = near_dedup.near_groups(documents(rows)).collect()
    assert "n_links" not in got[0].asDict()
    for r in got[::9]:
        own = sets[r.doc_id]
        assert r.n_verified_links <= sum(s != own and probability_jaccard(dict(own), x) >= 0.8 for s, x in different.items())


def test_empty_table(spark, documents):
    assert near_dedup.near_groups(documents([])).count() == 0
    assert near_dedup.drop_near_copies(documents([])).count() == 0
