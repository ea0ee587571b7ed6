"""Exact groups against a dictionary."""

from __future__ import annotations

import hashlib
import re

from kvloom.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [
    *[(i, "a  hot\ttext") for i in range(40, 10, -1)],
    (5, "a hot text"), (6, None), (7, ""), (8, " "), (9, "\n\n"), (None, "a hot\ntext"), (None, "lone"), (2, "twice"), (2, "twice"), (3, "Twice"),
    (100, "long " * 40000), (101, "long  " * 40000), (102, "é\u00a0b"), (103, "é b"),
]


def expected():
    groups = {}
    for i, t in ROWS:
        groups.setdefault(normal(t), []).append(i)
    return groups


def check(spark, documents, support):
    got = exact_dedup.exact_groups(documents(ROWS), support=support).collect()
    assert len(got) == len(ROWS)
    groups = expected()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert {r.text_sha256 for r in got} == set(by_hash)
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    for sha, ids in by_hash.items():
        kept = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_groups_with_heavy_split(spark, documents):
    check(spark, documents, 0.05)


def test_groups_with_few_counters(spark, documents):
    check(spark, documents, 0.4)


def test_heavy_digests_are_found(spark, documents):
    docs = documents([(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    heavy = exact_dedup.heavy_groups(exact_dedup._digests(docs, "text", "doc_id"), 0.1).collect()
    assert [(r.keep.id, r["size"]) for r in heavy] == [(0, 1000)]


def test_filter_keeps_rows_unchanged(spark, documents):
    docs = documents(ROWS)
    kept = exact_dedup.drop_exact_copies(docs, support=0.05)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(expected())


def test_filter_with_repeated_rows_and_without_a_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_SENT", 0)
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (None, "c"), (None, "c"), (3, "d"), (4, "d"), (4, "d")]
    kept = exact_dedup.drop_exact_copies(documents(rows), support=0.9).collect()
    assert sorted((str(r.doc_id), normal(r.text)) for r in kept) == [("1", "a b"), ("3", "d"), ("None", "c")]


def test_empty_table(spark, documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0
    assert exact_dedup.drop_exact_copies(documents([])).count() == 0
