"""The search query tree compiled to DataFrame conditions and scores.

A search over a plain table is one scan: texts are tokenised once, each node becomes a condition
and a score over the tokens, and corpus statistics are literals from one
aggregate over just the terms the query names.

Scores: BM25 for terms, synonyms and phrases (k1 1.2, b 0.75,
idf ln(1 + (N - df + 0.5) / (df + 0.5)), tf / (tf + k1 (1 - b + b dl / avgdl)));
1 for all other nodes; sums over MUST and SHOULD in booleans; products with
boosts.  N counts documents with a token in the field.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions import text as analysis
from kvloom.functions.ranges import conjunction, disjunction
from kvloom.plans import nodes as n
from kvloom.plans.forms import parse_standard

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """A table of documents: its key, and the analysis of each text field."""

    df: DataFrame
    key: str
    texts: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @staticmethod
    def tokens_name(name: str) -> str:
        return f"__tokens_{name}"

    def tokenised(self) -> DataFrame:
        return self.df.withColumns({self.tokens_name(f): analyse(F.col(f)) for f, analyse in self.texts.items()}) if self.texts else self.df

    def postings(self, name: str) -> DataFrame:
        """(term, key, position)."""
        return self.tokenised().select(self.key, F.posexplode(self.tokens_name(name)).alias("position", "term")).select("term", self.key, "position")

    def terms(self, name: str) -> DataFrame:
        """(term, df) of a text field."""
        each = self.tokenised().select(F.explode(F.array_distinct(self.tokens_name(name))).alias("term"))
        return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def text_index(df: DataFrame, key: str, *fields: str, analyse: Callable[[Column], Column] = analysis.tokens) -> Index:
    return Index(df, key, dict.fromkeys(fields, analyse))


@dataclass(frozen=True)
class Statistics:
    documents: dict[str, int]
    length: dict[str, float]
    holding: dict[tuple[str, str], int]

    def idf(self, name: str, term: str) -> float:
        total, df = self.documents.get(name, 0), self.holding.get((name, term), 0)
        return math.log(1 + (total - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Compiled:
    """Condition, and score of the rows that meet it."""

    match: Column
    score: Column


def terms_of(query: n.Query) -> set[tuple[str, str]]:
    """The (field, term) pairs whose statistics the scores need."""
    match query:
        case n.TermQuery(t):
            return {(t.field, t.value)}
        case n.PhraseQuery(phrase):
            return {(p.term.field, p.term.value) for p in phrase}
        case n.SynonymQuery(_, parts):
            return {(p.term.field, p.term.value) for p in parts}
    return set().union(*[terms_of(c) for c in n.children(query)])


class Compiler:
    def __init__(self, index: Index):
        self.index, self.scope, self.used = index, None, set()

    # rewriting: what needs a look at the data becomes plain nodes

    def rewritten(self, query: n.Query) -> n.Query:
        match query:
            case n.StandardQuery():
                return self.rewritten(parse_standard(query))
            case n.SolrTextQuery(name, phrase, slop):
                words = self.words(name, phrase)
                if not words:
                    return n.MatchNoDocsQuery()
                if len(words) == 1:
                    return n.TermQuery(n.Term(name, words[0]))
                return n.PhraseQuery(tuple(n.TermPosition(n.Term(name, w), i) for i, w in enumerate(words)), slop)
            case n.MoreLikeThisQuery():
                return self.more_like(query)
            case n.FuzzyQuery():
                terms = self.expanded(query)
                parts = tuple(n.BooleanQueryPart(n.TermQuery(n.Term(query.term.field, t)), n.Occur.SHOULD) for t in terms)
                return n.ConstantScoreQuery(n.BooleanQuery(parts, 1)) if parts else n.MatchNoDocsQuery()
            case n.BooleanQuery(parts, least):
                return n.BooleanQuery(tuple(n.BooleanQueryPart(self.rewritten(p.query), p.occur) for p in parts), least)
            case n.BoostQuery(inner, boost):
                return n.BoostQuery(self.rewritten(inner), boost)
            case n.ConstantScoreQuery(inner):
                return n.ConstantScoreQuery(self.rewritten(inner))
            case n.BoxedQuery(inner) | n.FilterConfigQuery(inner):
                return self.rewritten(inner)
        return query

    def words(self, name: str, text: str) -> list[str]:
        """The analysis of a text of the query, run by the same expression as the documents'."""
        analyse = self.index.texts.get(name, analysis.tokens)
        return list(self.index.df.sparkSession.range(1).select(analyse(F.lit(text)).alias("w")).first().w)

    def expanded(self, query: n.FuzzyQuery) -> list[str]:
        """The terms within the distance: the nearest ``maxExpansions``."""
        term, most = query.term.value, query.maxEdits
        listed = self.index.terms(query.term.field).where(F.length("term").between(len(term) - most, len(term) + most))
        if query.prefixLength:
            listed = listed.where(F.startswith("term", F.lit(term[: query.prefixLength])))
        distance = analysis.edit_distance(F.col("term"), term, most, query.transpositions)
        near = listed.withColumn("d", distance).where(F.col("d").isNotNull()).orderBy("d", "term").limit(query.maxExpansions)
        return [r.term for r in near.collect()]

    def more_like(self, query: n.MoreLikeThisQuery) -> n.Query:
        """A weighted OR over the seed's strongest terms, without the seed."""
        index = self.index
        seed = index.tokenised().where(F.col(index.key).cast("string") == query.id).limit(1)
        boosts = dict((b.split("^") + ["1"])[:2] for b in query.qf)
        chosen = []
        for name in query.fieldList:
            tokens = F.col(Index.tokens_name(name)) if query.maxNtp is None else F.slice(Index.tokens_name(name), 1, query.maxNtp)
            words = seed.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
            words = words.where((F.col("tf") >= (2 if query.minTf is None else query.minTf)) & F.length("term").between(query.minWl or 0, query.maxWl or 2**31 - 1))
            stats = self.statistics({(name, r.term) for r in words.select("term").collect()})
            total = stats.documents.get(name, 0)
            most = min(query.maxDf if query.maxDf is not None else total, total * query.maxDfPct // 100 if query.maxDfPct is not None else total)
            least = 5 if query.minDf is None else query.minDf
            for r in words.collect():
                if least <= stats.holding[name, r.term] <= most:
                    chosen.append((r.tf * stats.idf(name, r.term), name, r.term))
        best = sorted(chosen, key=lambda c: (-c[0], c[1], c[2]))[: 25 if query.maxQt is None else query.maxQt]
        if not best:
            return n.MatchNoDocsQuery()
        weight = lambda s, name: float(boosts.get(name, 1)) * (s / best[0][0] if query.boost else 1.0)
        parts = [n.BooleanQueryPart(n.BoostQuery(n.TermQuery(n.Term(name, t)), weight(s, name)), n.Occur.SHOULD) for s, name, t in best]
        return n.BooleanQuery((n.BooleanQueryPart(n.BooleanQuery(tuple(parts), 1), n.Occur.MUST), n.BooleanQueryPart(_KeyIs(query.id), n.Occur.MUST_NOT)))

    # statistics

    def statistics(self, terms: set[tuple[str, str]]) -> Statistics:
        """One aggregate over the documents for all terms of the query."""
        terms = {(f, t) for f, t in terms if f in self.index.texts}
        fields_ = sorted({f for f, _ in terms})
        if not fields_:
            return Statistics({}, {}, {})
        listed = sorted(terms)
        asked = []
        for i, name in enumerate(fields_):
            tokens = F.col(Index.tokens_name(name))
            asked += [F.count_if(F.size(tokens) > 0).alias(f"n{i}"), F.sum(F.size(tokens)).alias(f"l{i}")]
        asked += [F.count_if(F.array_contains(Index.tokens_name(f), t)).alias(f"t{i}") for i, (f, t) in enumerate(listed)]
        row = self.index.tokenised().agg(*asked).first()
        documents = {f: row[f"n{i}"] for i, f in enumerate(fields_)}
        length = {f: (row[f"l{i}"] or 0) / max(1, row[f"n{i}"]) for i, f in enumerate(fields_)}
        return Statistics(documents, length, {ft: row[f"t{i}"] for i, ft in enumerate(listed)})

    # compiling

    def compile(self, query: n.Query, scores: bool = True) -> Compiled:
        """The query over the columns of ``Index.tokenised``; ``used`` then names the text fields it reads."""
        self.plain = n.normalized(self.rewritten(query))
        self.stats = self.statistics(terms_of(self.plain)) if scores else Statistics({}, {}, {})
        return self._node(self.plain)

    def bound(self, tokens: Column) -> Compiled:
        """The compiled query over a struct of the tokens of each text field it reads."""
        self.scope = tokens
        try:
            return self._node(self.plain)
        finally:
            self.scope = None

    def pushed(self) -> Column:
        """What every match must meet and needs no text, for the scan."""
        parts = self.plain.parts if isinstance(self.plain, n.BooleanQuery) else ()
        found = []
        for p in parts:
            if p.occur in (n.Occur.MUST, n.Occur.FILTER):
                inner = Compiler(self.index)
                inner.plain, inner.stats = p.query, self.stats
                made = inner._node(p.query)
                found += [] if inner.used else [made.match]
        return conjunction(found)

    def tokens(self, name: str) -> Column:
        if name not in self.index.texts:
            raise ValueError(f"{name} is no text field")
        self.used.add(name)
        return F.col(Index.tokens_name(name)) if self.scope is None else self.scope[name]

    def bm25(self, name: str, tf: Column, idf: float) -> Column:
        average = self.stats.length.get(name) or 1.0
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.size(self.tokens(name)) / F.lit(average))
        return F.lit(idf) * tf / (tf + norm)

    def _node(self, query: n.Query) -> Compiled:
        one = F.lit(1.0)
        match query:
            case n.MatchAllDocsQuery():
                return Compiled(F.lit(True), one)
            case n.MatchNoDocsQuery():
                return Compiled(F.lit(False), one)
            case n.TermQuery(t):
                if t.field not in self.index.texts:
                    return Compiled(_true(F.col(t.field).cast("string") == t.value), one)
                tokens = self.tokens(t.field)
                tf = F.size(F.filter(tokens, lambda w: w == t.value))
                return Compiled(F.array_contains(tokens, t.value), self.bm25(t.field, tf, self.stats.idf(t.field, t.value)))
            case n.SynonymQuery(name, parts):
                tokens = self.tokens(name)
                tf = reduce(lambda a, b: a + b, [F.size(_only(tokens, p.term.value)) * F.lit(float(p.boost)) for p in parts])
                idf = min(self.stats.idf(p.term.field, p.term.value) for p in parts)
                return Compiled(F.arrays_overlap(tokens, F.array(*[F.lit(p.term.value) for p in parts])), self.bm25(name, tf, idf))
            case n.PhraseQuery(phrase, slop):
                return self._phrase(phrase, slop)
            case n.WildcardQuery(name, pattern):
                like = analysis.wildcard_like(pattern)
                return Compiled(F.exists(self.tokens(name), lambda w: F.like(w, F.lit(like))), one)
            case n.FieldExistsQuery(name) | n.SortedDocFieldExistsQuery(name):
                return Compiled(F.col(name).isNotNull(), one)
            case n.SortedNumericDocValuesFieldSlowRangeQuery(name, low, high):
                return Compiled(_true(F.col(name).between(low, high)), one)
            case n.NumericQuery():
                return Compiled(_true(_numeric(query)), one)
            case n.ConstantScoreQuery(inner):
                return Compiled(self._node(inner).match, one)
            case n.BoostQuery(inner, boost):
                inside = self._node(inner)
                return Compiled(inside.match, inside.score * F.lit(float(boost)))
            case n.SolrFunctionQuery(text, boost):
                return Compiled(F.lit(True), F.coalesce(formula(text).cast("double"), F.lit(0.0)) * F.lit(float(boost)))
            case n.BooleanQuery(parts, least):
                return self._boolean(parts, least)
            case _KeyIs(key):
                return Compiled(_true(F.col(self.index.key).cast("string") == key), one)
        raise NotImplementedError(type(query).__name__)

    def _boolean(self, parts: tuple[n.BooleanQueryPart, ...], least: int) -> Compiled:
        made = [(p.occur, self._node(p.query)) for p in parts]
        should = [c for o, c in made if o is n.Occur.SHOULD]
        needed = [c.match for o, c in made if o in (n.Occur.MUST, n.Occur.FILTER)]
        conditions = needed + [~c.match for o, c in made if o is n.Occur.MUST_NOT]
        least = least or (1 if should and not needed else 0)
        if least > len(should):
            return Compiled(F.lit(False), F.lit(0.0))
        if least == 1:
            conditions.append(disjunction([c.match for c in should]))
        elif least:
            conditions.append(reduce(lambda a, b: a + b, [c.match.cast("int") for c in should]) >= least)
        if not needed and not should:  # nothing but MUST_NOT selects nothing
            return Compiled(F.lit(False), F.lit(0.0))
        scores = [c.score for o, c in made if o is n.Occur.MUST] + [F.when(c.match, c.score).otherwise(0.0) for c in should]
        return Compiled(conjunction(conditions), reduce(lambda a, b: a + b, scores) if scores else F.lit(0.0))

    def _phrase(self, phrase: tuple[n.TermPosition, ...], slop: int) -> Compiled:
        """Occurrences that start at i: every term within i to i + slop of its place."""
        if not phrase:
            return Compiled(F.lit(False), F.lit(0.0))
        name, base = phrase[0].term.field, min(p.position for p in phrase)
        places = [(p.position - base, p.term.value) for p in phrase]
        distinct = sorted({t for _, t in places})

        def occurrences(tokens: Column) -> Column:
            at, word = places[0]
            spots = F.filter(F.transform(tokens, lambda w, i: F.when(w == word, i - at)), lambda i: i.isNotNull())
            return F.size(F.filter(phrase_starts(spots, slop), lambda i: F.coalesce(holds(tokens, i), F.lit(False))))

        def holds(tokens: Column, i: Column) -> Column:
            if slop == 0:
                return (i >= 0) & conjunction([F.get(tokens, i + at) == t for at, t in places])
            begin = lambda at: F.greatest(i + at, F.lit(0))
            return conjunction([F.array_contains(F.slice(tokens, begin(at) + 1, F.greatest(i + at + slop + 1, F.lit(0)) - begin(at)), t) for at, t in places])

        # bound to a variable, the tokens are made once a row, wherever the optimiser moves the condition
        found = F.get(F.transform(F.array(self.tokens(name)), occurrences), F.lit(0))
        every = conjunction([F.array_contains(self.tokens(name), t) for t in distinct])
        return Compiled(every & (found > 0), self.bm25(name, found, sum(self.stats.idf(name, t) for t in distinct)))


def phrase_starts(spots: Column, slop: int) -> Column:
    """Where a phrase may start if its first term is due at ``spots``."""
    return F.array_distinct(F.flatten(F.transform(spots, lambda i: F.sequence(i - slop, i)))) if slop else spots


@dataclass(frozen=True)
class _KeyIs(n.Query):
    key: str


def _only(tokens: Column, term: str) -> Column:
    return F.filter(tokens, lambda w: w == term)


def _true(condition: Column) -> Column:
    """Unknown is no match."""
    return F.coalesce(condition, F.lit(False))


def _numeric(q: n.NumericQuery) -> Column:
    column, typed = F.col(q.field), lambda v: F.lit(v).cast(q.spark_type)
    if q.kind == "PointSet":
        return column.isin([typed(v) for v in q.values]) if q.values else F.lit(False)
    if not q.nd:
        return column.between(typed(q.min), typed(q.max)) if q.kind == "PointRange" else column == typed(q.value)
    lows, highs = (q.min, q.max) if q.kind == "PointRange" else (q.value, q.value)
    inside = [F.get(column, F.lit(i)).between(typed(a), typed(b)) for i, (a, b) in enumerate(zip(lows, highs, strict=True))]
    return conjunction([F.size(column) >= len(lows) if q.kind == "PointRange" else F.size(column) == len(lows), *inside])


#: What a function query may call.
FORMULAS: dict[str, Callable[..., Column]] = {
    "sum": lambda *a: reduce(lambda x, y: x + y, a),
    "product": lambda *a: reduce(lambda x, y: x * y, a),
    "sub": lambda a, b: a - b,
    "div": lambda a, b: a / F.nullif(b, F.lit(0)),
    "pow": F.pow,
    "sqrt": F.sqrt,
    "log": F.log10,
    "ln": F.log,
    "abs": F.abs,
    "max": lambda *a: F.greatest(*a),
    "min": lambda *a: F.least(*a),
}


def formula(text: str) -> Column:
    """A formula of field names, numbers, arithmetic and the functions of FORMULAS as a Column."""

    def of(x: ast.AST) -> Column:
        match x:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name):
                return F.col(name).cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -of(inner)
            case ast.BinOp(left=a, op=op, right=b):
                left, right = of(a), of(b)
                kinds = {ast.Add: lambda: left + right, ast.Sub: lambda: left - right, ast.Mult: lambda: left * right, ast.Div: lambda: left / F.nullif(right, F.lit(0.0))}
                if type(op) in kinds:
                    return kinds[type(op)]()
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FORMULAS:
                return FORMULAS[name](*[of(a) for a in args])
        raise ValueError(f"not allowed in a formula: {ast.unparse(x)}")

    return of(ast.parse(text, mode="eval").body)
