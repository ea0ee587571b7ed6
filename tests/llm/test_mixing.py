"""Water-filling against the iterative definition, sampling against a plain loop."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from kvloom.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1), epochs=3) -> dict:
    """Clamp and share out again until no source is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped: dict = {}
    while True:
        open_ = [s for s in names if s not in clamped]
        left = sum(sizes.values()) - sum(clamped.values())
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: epochs * sizes[s] for s in over}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def expected(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, out = fill(sizes), {}
    for source in sizes:
        place = lambda r: md5(f"mix-1|{r[0]}|{md5(r[1] or '')}")
        start, whole = 0, int(target[source] // sizes[source]) if sizes[source] else 0
        for r in sorted((r for r in rows if r[3] == source), key=place):
            n = size(r[1])
            out[r[0]] = (n, sizes[source], target[source], n * (whole + (start + n / 2 <= target[source] - whole * sizes[source])))
            start += n
    return out


def rows_of(seed: int, n: int):
    r = random.Random(seed)
    source = lambda: r.choice(["a", "b", "b", "c", "d", "é", None, "Z"])
    return [(i, r.choice([None, "", " ", "w " * r.randint(1, 60)]), "en", source()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_equals_the_definition(spark, documents, seed):
    rows = rows_of(seed, 300)
    got = {r.doc_id: r for r in mixing.mix_plan(documents(rows)).collect()}
    for i, (size, source_size, target, taken) in expected(rows).items():
        assert (got[i].size, got[i].source_size) == (size, source_size)
        assert got[i].target == pytest.approx(target) and got[i].taken == taken
        assert got[i].taken <= 3 * size


def test_targets_are_met_and_reruns_agree(spark, documents):
    rows = rows_of(9, 800)
    one, two = ([tuple(r) for r in mixing.mix_plan(documents(rows)).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two
    for source in {r[1] for r in one}:
        mine = [r for r in one if r[1] == source]
        assert abs(sum(r[5] for r in mine) - mine[0][4]) <= max(r[2] for r in mine)


def test_mix_keeps_columns_and_taken_rows(spark, documents):
    rows = [*rows_of(4, 200), (1000, "repeated row", "en", "a"), (1000, "repeated row", "en", "a"), (None, "no id", "en", None)]
    docs = documents(rows)
    mix = mixing.mix(docs)
    assert mix.columns[: len(docs.columns)] == docs.columns
    plan = mixing.mix_plan(docs)
    assert mix.agg({"mix_taken": "sum"}).first()[0] == plan.agg({"taken": "sum"}).first()[0]
    assert mix.where("mix_repeats = 0").count() == 0


def test_partitioning_does_not_matter_when_ids_repeat_or_are_null(spark, documents):
    r = random.Random(5)
    rows = [(r.choice([None, i % 40]), f"text {r.randint(0, 500)} " * r.randint(0, 9), "en", r.choice("ab")) for i in range(2000)]
    docs = documents(rows)
    one, two = (sorted((tuple(x) for x in mixing.mix_plan(d).collect()), key=str) for d in (docs.repartition(3), docs.repartition(11, "text")))
    assert one == two


def test_no_document_goes_over_the_most_epochs(spark, documents):
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, " ", "en", "a"), (4, "w", "en", "a"), *[(10 + i, "w " * 50, "en", "b") for i in range(9)]]
    got = {r.doc_id: r.mix_repeats for r in mixing.mix(documents(rows)).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [3, 3, 3, 3] and max(got.values()) == 3


def test_empty_and_wordless_tables(spark, documents):
    assert mixing.mix_plan(documents([])).count() == 0
    got = mixing.mix_plan(documents([(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
