"""Registered queries against their SQL on whole small tables, and the pipeline's stages."""

from __future__ import annotations

import math

import duckdb
import pytest
import regex
import xxhash

import corpus_pipeline
from kvloom.llm import queries, toxicity
from tests.llm.conftest import DATA
from tests.llm.test_decontaminate import expected as leaks
from tests.llm.test_exact_dedup import normal
from tests.llm.test_mixing import expected as mix
from tests.llm.test_near_dedup import brute_groups

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def rejected(text: str, chain: toxicity.Chain) -> bool:
    """The chain's decision on one text, summed word by word."""
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    known, features = {int(h): i for i, h in enumerate(chain.vocabulary)}, set()
    for word in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
        features.add(signed(xxhash.xxh64_intdigest(word.encode(), seed=42)))
        for n in toxicity.STEMS:
            if len(word) > n:
                stem = xxhash.xxh64_intdigest(word[:n].encode(), seed=42)
                features.add(signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=stem)))
    earlier = []
    for model in chain.models:
        z = model.bias + sum(model.words[known[f]] for f in features if f in known) + sum(w * p for w, p in zip(model.chain, earlier, strict=True))
        earlier.append(1 / (1 + math.exp(-z)))
    return bool(earlier) and earlier[-1] >= toxicity.THRESHOLD


def test_pipeline_equals_its_parts(spark):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(before[i] == t for i, t in after.items())
        if name != "mixing":
            assert docs.columns == columns
        match name:
            case "toxicity":
                chain = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
                assert set(after) == {i for i, t in before.items() if not rejected(t, chain)} and len(after) < len(before)
            case "exact_dedup":
                first: dict = {}
                for i in sorted(before):
                    first.setdefault(normal(before[i]), i)
                assert set(after) == set(first.values())
            case "near_dedup":
                assert set(after) == set(brute_groups(list(before.items())).values())
            case "decontamination":
                assert set(before) - set(after) == {i for i, *_ in leaks(list(before.items()), items)}
            case "mixing":
                want = mix([(i, before[i], None, sources[i]) for i in before])
                assert {r.doc_id: r.mix_taken for r in docs.collect() if r.mix_size} == {i: taken for i, (*_, taken) in want.items() if taken}
        sources = {r.doc_id: r.source for r in docs.collect()}
    assert docs.where("mix_taken <> mix_size * mix_repeats").count() == 0


def test_run_gives_the_mix(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "mix_repeats" in out.columns
