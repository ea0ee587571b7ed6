"""Containment pairs against brute force."""

from __future__ import annotations

import random
import re

from kvloom.llm import decontaminate
from tests.llm.test_near_dedup import WORD


def grams(text, n):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def expected(docs, items):
    found = set()
    for item, text in items:
        words = WORD.findall((text or "").lower())
        if not words:
            continue
        n = min(5, len(words))
        mine = grams(text, n)
        for i, t in docs:
            shared = len(mine & grams(t, n))
            if shared >= 0.8 * len(mine) - 1e-9:
                found.add((i, item, shared, len(mine)))
    return found


def tables():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 8, 20, 36, 37, 60, 200, 900])] + [(20, None), (21, "!?"), (22, "Same Item here and there"), (23, "same item; here AND there")]
    docs = []
    for i, (_, t) in enumerate(items):
        for edits in (0, 1, 2, 5):
            w = (t or "").split()
            for _ in range(edits * len(w) // 40):
                w[r.randrange(len(w))] = word()
            docs.append((len(docs), text(r.choice([0, 30, 3000])) + "\n" + " ".join(w).upper() + ". " + text(50)))
    return [*docs, (900, None), (901, ""), (902, text(20000) + " " + items[6][1]), (3, docs[3][1]), (4, "another text of the same id"), (None, items[7][1])], items


def test_pairs_equal_brute_force(spark, documents):
    docs, items = tables()
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, doc_id int")
    got = decontaminate.contaminated_pairs(documents(docs), table).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == expected(docs, items)
    assert len(got) == len({(r.doc_id, r.body, r.item_id) for r in got})


def test_filter_keeps_clean_rows_unchanged(spark, documents):
    docs, items = tables()
    table = spark.createDataFrame(items, "item_id int, text string")
    bad = {(i) for i, *_ in expected(docs, items)}
    kept = decontaminate.drop_contaminated(documents(docs), table)
    assert kept.columns == documents(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if i not in bad or t == "another text of the same id")


def test_sketches_are_partitioned_by_size(spark):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (2, " ".join(f"x{i}" for i in range(500)))], "item_id int, text string")
    sketch = decontaminate.sketches(decontaminate.item_shingles(items), 0.8).groupBy("item_id", "need").count().orderBy("item_id").collect()
    assert [(r.item_id, r.need, r["count"]) for r in sketch] == [(1, 2, 2), (2, 15, 114)]


def test_no_contained_item_is_lost_by_its_sketch(spark, documents):
    """The shingles that a document misses are those of the sketch, as many as the threshold allows."""
    items = []
    for i, n in enumerate([40, 64, 100, 127, 128, 300]):
        words = [f"v{i}x{k}" for k in range(5 * n)]
        items.append((i, " ".join(words)))
    table = spark.createDataFrame(items, "item_id int, text string")
    sketch = decontaminate.sketches(decontaminate.item_shingles(table), 0.8).groupBy("item_id").agg({"h": "collect_set", "need": "max"}).collect()
    sizes = dict(decontaminate.item_shingles(table).groupBy("item_id").count().collect())
    for r in sketch:
        held, may_miss = len(r["collect_set(h)"]), int(0.2 * sizes[r.item_id] + 1e-9)
        assert held - may_miss == r["max(need)"] >= 12


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contaminated_pairs(documents([(1, "a b c d e")]), none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e")], "item_id int, text string")
    assert decontaminate.drop_contaminated(documents([]), one).count() == 0


def test_word_rule():
    assert re.sub(r"\W|_", "", "A_b") == "Ab"
