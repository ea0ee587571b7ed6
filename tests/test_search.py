"""The query tree: text forms, normalisation, and matches against plain Python."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from kvloom.functions import text
from kvloom.plans import forms
from kvloom.plans import nodes as n
from kvloom.plans import stored as stored_index
from kvloom.plans.compiler import Compiler, text_index
from kvloom.plans.search import Hits, ScoreMode, matches, search
from kvloom.plans.stored import write_index

DOCS = [
    (1, "the quick brown fox", 3, [1.0, 2.0], 1.5), (2, "quick fox, brown dog", 7, [0.0, 0.5], 2.5), (3, "lazy dog sleeps; lazy lazy dog", None, [1.0, 2.0], 3.5),
    (4, None, 9, None, None), (5, "fox", 7, [5.0, 5.0, 5.0], 1.5), (6, "brown quick the fox brown", 1, [1.0, 2.5], 0.5),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "id int, body string, num int, vec array<double>, d double").withColumn("big", F.col("num").cast("bigint")).withColumn("f", F.col("d").cast("float"))
    return text_index(df, "id", "body")


def ids(index, q):
    return sorted(r.id for r in matches(index, q).collect())


def term(word, field="body"):
    return n.TermQuery(n.Term(field, word))


def part(q, occur):
    return n.BooleanQueryPart(q, occur)


MUST, NOT, SHOULD, FILTER = n.Occur.MUST, n.Occur.MUST_NOT, n.Occur.SHOULD, n.Occur.FILTER


def phrase(slop, *words):
    return n.PhraseQuery(tuple(n.TermPosition(n.Term("body", w), i) for i, w in enumerate(words)), slop)


CASES = [
    (term("fox"), [1, 2, 5, 6]),
    (term("7", "num"), [2, 5]),
    (phrase(0, "quick", "brown"), [1]),
    (phrase(1, "quick", "brown"), [1, 2]),
    (phrase(0, "brown", "fox"), [1]),
    (phrase(2, "brown", "quick"), [1, 6]),
    (phrase(3, "brown", "quick"), [1, 2, 6]),
    (phrase(3, "quick", "brown"), [1, 2, 6]),
    (n.SolrTextQuery("body", "Lazy DOG"), [3]),
    (n.SolrTextQuery("body", "fox"), [1, 2, 5, 6]),
    (n.SolrTextQuery("body", "!?"), []),
    (n.WildcardQuery("body", "*ow?"), [1, 2, 6]),
    (n.WildcardQuery("body", "fo%"), []),
    (n.FuzzyQuery(n.Term("body", "bronw"), 1, 0, 50, True), [1, 2, 6]),
    (n.FuzzyQuery(n.Term("body", "bronw"), 1, 0, 50, False), []),
    (n.FuzzyQuery(n.Term("body", "bronw"), 2, 2, 50, False), [1, 2, 6]),
    (n.FuzzyQuery(n.Term("body", "fix"), 2, 0, 1, False), [1, 2, 5, 6]),
    (n.SynonymQuery("body", (n.TermAndBoost(n.Term("body", "lazy"), 1.0), n.TermAndBoost(n.Term("body", "the"), 0.5))), [1, 3, 6]),
    (n.FieldExistsQuery("num"), [1, 2, 4, 5, 6]),
    (n.SortedDocFieldExistsQuery("body"), [1, 2, 3, 5, 6]),
    (n.SortedNumericDocValuesFieldSlowRangeQuery("num", 3, 7), [1, 2, 5]),
    (n.MatchAllDocsQuery(), [1, 2, 3, 4, 5, 6]),
    (n.MatchNoDocsQuery(), []),
    (n.IntPointSetQuery("num", (1, 9)), [4, 6]),
    (n.LongPointSetQuery("big", ()), []),
    (n.FloatPointSetQuery("f", (1.5,)), [1, 5]),
    (n.DoublePointSetQuery("d", (0.5, 3.5)), [3, 6]),
    (n.DoubleNDPointExactQuery("vec", (1.0, 2.0)), [1, 3]),
    (n.DoubleNDTermQuery("vec", (5.0, 5.0, 5.0)), [5]),
    (n.DoubleNDPointRangeQuery("vec", (1.0, 2.0), (1.0, 2.5)), [1, 3, 6]),
    (n.BooleanQuery((part(term("fox"), MUST), part(term("quick"), NOT))), [5]),
    (n.BooleanQuery((part(term("fox"), NOT),)), []),
    (n.BooleanQuery((part(term("fox"), SHOULD), part(term("dog"), SHOULD), part(n.IntPointExactQuery("num", 7), SHOULD)), 2), [2, 5]),
    (n.BooleanQuery((part(term("fox"), FILTER), part(term("dog"), SHOULD))), [1, 2, 5, 6]),
    (n.BooleanQuery((part(term("fox"), SHOULD),), 2), []),
    (n.ConstantScoreQuery(n.BoxedQuery(n.FilterConfigQuery(term("dog"), True))), [2, 3]),
    (n.StandardQuery("fox -quick", ("body",)), [5]),
    (n.StandardQuery('"quick brown"~1 OR lazy', ("body",)), [1, 2, 3]),
    (n.StandardQuery("(fox AND dog) num:[8 TO *]", ("body",), (n.PointConfig("num", n.PointType.INT),)), [2, 4]),
    (n.StandardQuery("num:{1 TO 7}", ("body",), (n.PointConfig("num", n.PointType.INT),)), [1]),
    (n.StandardQuery("qui* AND dgo~1", ("body",)), [2]),
    (n.SolrFunctionQuery("num * 2", 1.0), [1, 2, 3, 4, 5, 6]),
]


@pytest.mark.parametrize(("q", "want"), CASES, ids=[f"{i}-{type(q).__name__}" for i, (q, _) in enumerate(CASES)])
def test_matches(index, q, want):
    assert ids(index, q) == want


@pytest.fixture(scope="module")
def stored(index, tmp_path_factory):
    return write_index(index, str(tmp_path_factory.mktemp("index") / "i"))


MORE = [n.BoostQuery(any_, 2.0) for any_ in (n.SynonymQuery("body", (n.TermAndBoost(n.Term("body", "fox"), 1.0), n.TermAndBoost(n.Term("body", "dog"), 0.5))), phrase(2, "brown", "quick"))]
MORE += [n.MoreLikeThisQuery("1", ("body",), minTf=1, minDf=1, maxQt=2, minWl=4), n.MoreLikeThisQuery("99", ("body",)), n.WildcardQuery("body", "f?x"), n.MatchAllDocsQuery(), n.MatchNoDocsQuery()]
MORE += [n.BooleanQuery((part(term("fox"), MUST), part(term("dog"), SHOULD), part(n.BoostQuery(term("brown"), 3.0), SHOULD))), n.BooleanQuery((part(term("fox"), SHOULD), part(term("fox"), SHOULD), part(phrase(0, "fox"), SHOULD)), 3)]


@pytest.mark.parametrize("q", [q for q, _ in CASES] + MORE)
def test_a_stored_index_gives_the_same_rows_and_scores(index, stored, q):
    rows = lambda of: {r.id: (r.body, r.score) for r in matches(of, q).collect()}
    got, want = rows(stored), rows(index)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == pytest.approx({i: x[1] for i, x in want.items()}, abs=2e-6)
    assert {r.id for r in matches(stored, q, ScoreMode.NO_SCORES, ["id"]).collect()} == set(want)


def test_a_term_query_reads_the_postings_of_its_term(stored):
    plan = matches(stored, term("fox"), columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,body)" in plan and ("EqualTo(term,fox)" in plan or "In(term, [fox])" in plan) and "documents" not in plan


def test_postings_are_gathered_where_their_documents_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "RUN", 5)
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"b a é {'long ' * (i % 5)}w{i % 3} a") for i in range(40)] + [(None, "a z"), (3, "b b"), (3, "b b"), (3, "c")]
    df = spark.createDataFrame(rows, "id int, body string")
    plan = stored_index.occurrences(text_index(df, "id", "body").tokenised().selectExpr("id AS key", "__tokens_body AS tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    for name, kept in (("once", rows[:41]), ("repeated", rows)):
        path, want = str(tmp_path / name), {}
        write_index(text_index(spark.createDataFrame(kept, "id int, body string"), "id", "body"), path)
        for key, body in kept:
            words = (body or "").split()
            for place, word in enumerate(words):
                want.setdefault((word, key, len(words)), []).append(place)
        got = {(r.term, r.key, r.length): r.positions for r in spark.read.parquet(f"{path}/postings").collect()}
        assert got == {k: sorted(v) for k, v in want.items()}
        lengths = {(k, size) for _, k, size in want}
        assert [(r.documents, r.length) for r in spark.read.parquet(f"{path}/fields").collect()] == [(len(lengths), sum(x for _, x in lengths))]


def test_a_query_without_text_writes_no_postings(index, tmp_path):
    held = stored_index.write_documents(index, str(tmp_path))
    params = n.QueryParams(term("7", "num"), 0, 5, n.DocSort())
    assert [r.id for r in search(held, params).collect()] == [2, 5] and {p.name for p in tmp_path.iterdir()} == {"documents"}
    assert ids(held, term("fox")) == [1, 2, 5, 6] and {p.name for p in tmp_path.iterdir()} == {"documents", "postings", "terms", "fields"}


def test_pages_of_a_stored_index(stored, index):
    for sort in (n.DocSort(), n.NumericSort("num", True), n.ScoreSort(), n.RandomSort("s")):
        params = n.QueryParams(term("fox"), 1, 2, sort)
        assert [tuple(r) for r in search(stored, params).collect()] == [tuple(r) for r in search(index, params).collect()]


NUMERIC = [(name, cls) for name, cls in sorted(n.QUERIES.items()) if issubclass(cls, n.NumericQuery)]


@pytest.mark.parametrize(("name", "cls"), NUMERIC)
def test_every_numeric_node_compiles(index, name, cls):
    column = "vec" if cls.nd else {"int": "num", "bigint": "big", "float": "f", "double": "d"}[cls.spark_type]
    values = {"PointSet": ((1, 7),), "PointRange": ((0, 0), (9, 9)) if cls.nd else (0, 9)}.get(cls.kind, ((1, 2),) if cls.nd else (7,))
    assert isinstance(ids(index, cls(column, *values)), list)


def test_there_are_all_nodes():
    assert len(n.QUERIES) >= 47 - 1 and {"IntNDPointExactQuery", "LongTermQuery", "FloatNDPointRangeQuery", "DoublePointSetQuery"} <= set(n.QUERIES)


def test_bm25(index):
    got = {r.id: r.score for r in matches(index, n.BoostQuery(term("lazy"), 2.0)).collect()}
    lengths = [4, 4, 6, 1, 5]
    idf = math.log(1 + (5 - 1 + 0.5) / 1.5)
    assert got == {3: round(2 * idf * 3 / (3 + 1.2 * (0.25 + 0.75 * 6 / (sum(lengths) / 5))), 6)}


def test_more_like_this(index):
    q = n.MoreLikeThisQuery("1", ("body",), minTf=1, minDf=1, maxQt=2, minWl=4)
    assert ids(index, q) == [2, 6]
    assert ids(index, n.MoreLikeThisQuery("99", ("body",))) == []


def test_more_like_this_reads_the_whole_seed(spark):
    df = spark.createDataFrame([(1, "early " * 5000 + "late late"), (2, "late"), (3, "early"), (4, "other")], "id int, body string")
    q = n.MoreLikeThisQuery("1", ("body",), minTf=2, minDf=1)
    assert ids(text_index(df, "id", "body"), q) == [2, 3]
    assert ids(text_index(df, "id", "body"), n.MoreLikeThisQuery("1", ("body",), minTf=2, minDf=1, maxNtp=5000)) == [3]


def test_pages_orders_and_counts(index):
    every = n.MatchAllDocsQuery()
    orders = [n.NoSort(), n.DocSort(), n.NumericSort("num"), n.NumericSort("num", True), n.RandomSort("s"), n.ScoreSort()]
    for sort, offset, limit, precise in itertools.product(orders, (0, 2), (3, None), (True, False)):
        hits = search(index, n.QueryParams(every, offset, limit, sort, precise))
        assert isinstance(hits, Hits) and len(hits.collect()) == min(6 - offset, limit or 6)
        assert str(hits.total()) == ("6" if precise or limit is None else f"{offset + limit + 1}+" if offset + limit + 1 <= 6 else "6") or (offset + limit == 5)
    assert [r.id for r in search(index, n.QueryParams(every, 1, 2, n.NumericSort("num", True))).collect()] == [2, 5]
    assert [r.id for r in search(index, n.QueryParams(term("fox"), 0, 1)).collect()] == [5]
    labels = index.df.sparkSession.createDataFrame([(5, "x")], "id int, label string")
    assert {r.id: r.label for r in search(index, n.QueryParams(term("fox"))).enriched(labels).collect()} == {1: None, 2: None, 5: "x", 6: None}
    assert "score" not in search(index, n.QueryParams(every, sort=n.DocSort())).page.columns
    assert "score" in search(index, n.QueryParams(every, sort=n.DocSort()), ScoreMode.COMPLETE).page.columns
    assert len(search(index, n.QueryParams(every, timeoutMilliseconds=600_000)).collect()) == 6


def test_json_reads_back():
    for q, _ in CASES:
        assert forms.from_json(forms.to_json(q)) == q
    for bad in ('{"properties":{},"type":"MatchAllDocsQuery"}', '{"type":"Nope","properties":{}}', '{"type":"TermQuery","properties":{"x":1}}', '{"type":"TermQuery","properties":{}}'):
        with pytest.raises(ValueError):
            forms.from_json(bad)


def test_xml():
    q = n.BooleanQuery((part(n.BoostQuery(term("a<b"), 2.0), MUST), part(n.IntPointSetQuery("num", (1,)), SHOULD), part(n.ConstantScoreQuery(n.MatchAllDocsQuery()), FILTER)), 1)
    assert forms.to_xml(q) == (
        '<BooleanQuery minimumNumberShouldMatch="1"><Clause occurs="must"><TermQuery boost="2.0" fieldName="body">a&lt;b</TermQuery></Clause>'
        '<Clause occurs="should"><BooleanQuery minimumNumberShouldMatch="1"><Clause occurs="should"><PointRangeQuery type="int" fieldName="num" lowerTerm="1" upperTerm="1"/></Clause></BooleanQuery></Clause>'
        '<Clause occurs="filter"><ConstantScoreQuery><UserQuery>*:*</UserQuery></ConstantScoreQuery></Clause></BooleanQuery>'
    )
    assert forms.to_xml(n.BoostQuery(n.BoostQuery(term("x"), 2.0), 3.0)) == '<TermQuery boost="6.0" fieldName="body">x</TermQuery>'
    assert forms.to_xml(phrase(2, "a", "b")).startswith('<SpanNear slop="2"')
    with pytest.raises(NotImplementedError):
        forms.to_xml(n.WildcardQuery("body", "a*"))


def test_normal_form():
    inner = n.BooleanQuery((part(term("a"), MUST), part(term("b"), NOT)))
    assert n.normalized(n.BooleanQuery((part(n.BoxedQuery(term("a")), MUST),))) == term("a")
    assert n.normalized(n.BooleanQuery((part(inner, MUST), part(term("c"), SHOULD)))) == n.BooleanQuery((part(term("a"), MUST), part(term("b"), NOT), part(term("c"), SHOULD)))


@pytest.mark.parametrize("bad", ["", "(a", "a)", "num:[a TO b]", "+", '"open'])
def test_bad_text_queries(bad):
    with pytest.raises(ValueError):
        forms.parse_standard(n.StandardQuery(bad, ("body",)))


def test_unknown_text_field(index):
    with pytest.raises(ValueError):
        Compiler(index).compile(n.WildcardQuery("num", "a*"))


def test_coordinates(spark):
    df = spark.createDataFrame([(1, 52.52, 13.405), (2, 48.137, 11.575), (3, 52.4, 13.06)], "id int, lat double, lon double")
    assert [r.id for r in df.where(text.within_km(F.col("lat"), F.col("lon"), 52.52, 13.405, 30)).collect()] == [1, 3]
