"""The search query tree.

Every node is a frozen dataclass whose name and fields are the public form of
the tree.  Numeric nodes exist for four point types, with one value or an
array (ND) for n-dimensional points, and are made from one table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, make_dataclass
from enum import Enum
from typing import Any


class Query:
    """Any node."""


class Occur(Enum):
    MUST = "OccurMust"
    MUST_NOT = "OccurMustNot"
    SHOULD = "OccurShould"
    FILTER = "OccurFilter"


class PointType(Enum):
    INT = "PointTypeInt"
    LONG = "PointTypeLong"
    FLOAT = "PointTypeFloat"
    DOUBLE = "PointTypeDouble"


@dataclass(frozen=True)
class Term:
    field: str
    value: str


@dataclass(frozen=True)
class TermPosition:
    term: Term
    position: int


@dataclass(frozen=True)
class TermAndBoost:
    term: Term
    boost: float


@dataclass(frozen=True)
class PointConfig:
    field: str
    type: PointType


@dataclass(frozen=True)
class BoxedQuery(Query):
    query: Query


@dataclass(frozen=True)
class StandardQuery(Query):
    query: str
    defaultFields: tuple[str, ...]
    pointsConfig: tuple[PointConfig, ...] = ()
    termFields: tuple[str, ...] = ()


@dataclass(frozen=True)
class TermQuery(Query):
    term: Term


@dataclass(frozen=True)
class FieldExistsQuery(Query):
    field: str


@dataclass(frozen=True)
class FilterConfigQuery(Query):
    query: Query
    cached: bool = True


@dataclass(frozen=True)
class SolrFunctionQuery(Query):
    query: str
    boost: float = 1.0


@dataclass(frozen=True)
class MoreLikeThisQuery(Query):
    id: str
    fieldList: tuple[str, ...]
    minTf: int | None = None
    minDf: int | None = None
    maxDf: int | None = None
    maxDfPct: int | None = None
    minWl: int | None = None
    maxWl: int | None = None
    maxQt: int | None = None
    maxNtp: int | None = None
    boost: bool | None = None
    qf: tuple[str, ...] = ()


@dataclass(frozen=True)
class PhraseQuery(Query):
    phrase: tuple[TermPosition, ...]
    slop: int = 0


@dataclass(frozen=True)
class SolrTextQuery(Query):
    field: str
    phrase: str
    slop: int = 0


@dataclass(frozen=True)
class WildcardQuery(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class SynonymQuery(Query):
    field: str
    parts: tuple[TermAndBoost, ...]


@dataclass(frozen=True)
class FuzzyQuery(Query):
    term: Term
    maxEdits: int = 2
    prefixLength: int = 0
    maxExpansions: int = 50
    transpositions: bool = True


@dataclass(frozen=True)
class MatchAllDocsQuery(Query):
    pass


@dataclass(frozen=True)
class MatchNoDocsQuery(Query):
    pass


@dataclass(frozen=True)
class BooleanQueryPart:
    query: Query
    occur: Occur


@dataclass(frozen=True)
class BooleanQuery(Query):
    parts: tuple[BooleanQueryPart, ...]
    minShouldMatch: int = 0


@dataclass(frozen=True)
class SortedNumericDocValuesFieldSlowRangeQuery(Query):
    field: str
    min: int
    max: int


@dataclass(frozen=True)
class SortedDocFieldExistsQuery(Query):
    field: str


@dataclass(frozen=True)
class ConstantScoreQuery(Query):
    query: Query


@dataclass(frozen=True)
class BoostQuery(Query):
    query: Query
    scoreBoost: float


class NumericQuery(Query):
    """A node over a numeric field: ``kind`` term, exact, range or set; ``spark_type``; ``nd`` for arrays."""

    kind: str
    spark_type: str
    nd: bool


#: (Python type, Spark type) by point type.
POINTS = {"Int": (int, "int"), "Long": (int, "bigint"), "Float": (float, "float"), "Double": (float, "double")}
#: Fields by kind; a set exists for one dimension only.
KINDS = {"Term": ("value",), "PointExact": ("value",), "PointRange": ("min", "max"), "PointSet": ("values",)}


def _numeric() -> dict[str, type]:
    made = {}
    for point, (python, spark) in POINTS.items():
        for kind, names in KINDS.items():
            for nd in (False, True):
                if nd and kind == "PointSet":
                    continue
                name = f"{point}ND{kind}Query" if nd else f"{point}{kind}Query"
                value = tuple if nd or kind == "PointSet" else python
                space = {"kind": kind, "spark_type": spark, "nd": nd, "__module__": __name__, "__doc__": f"{kind} over {'points of ' * nd}{point} fields."}
                made[name] = make_dataclass(name, [("field", str), *((n, value) for n in names)], bases=(NumericQuery,), frozen=True, namespace=space)
    return made


globals().update(_numeric())


# search requests


@dataclass(frozen=True)
class NoSort:
    pass


@dataclass(frozen=True)
class NumericSort:
    field: str
    reverse: bool = False


@dataclass(frozen=True)
class RandomSort:
    seed: str = "0"


@dataclass(frozen=True)
class ScoreSort:
    pass


@dataclass(frozen=True)
class DocSort:
    pass


@dataclass(frozen=True)
class QueryParams:
    query: Query
    offset: int = 0
    limit: int | None = None
    sort: Any = field(default_factory=ScoreSort)
    computePreciseHitsCount: bool = True
    timeoutMilliseconds: int | None = None


@dataclass(frozen=True)
class TotalHitsCount:
    value: int
    exact: bool

    def __str__(self) -> str:
        return str(self.value) if self.exact else f"{self.value}+"


#: Every class by its public name.
TYPES: dict[str, type] = {n: x for n, x in list(globals().items()) if isinstance(x, type) and is_dataclass(x)}
QUERIES: dict[str, type] = {n: x for n, x in TYPES.items() if issubclass(x, Query)}


def children(query: Query) -> list[Query]:
    """The queries directly inside a node."""
    found = []
    for f in fields(query):
        value = getattr(query, f.name)
        found += [value] if isinstance(value, Query) else [p.query for p in value if isinstance(p, BooleanQueryPart)] if isinstance(value, tuple) else []
    return found


def normalized(query: Query) -> Query:
    """The same query without wrappers and cache hints, with flat booleans, multiplied boosts and sets for what they are."""
    match query:
        case BoxedQuery(inner) | FilterConfigQuery(inner):
            return normalized(inner)
        case BoostQuery(inner, boost):
            inside = normalized(inner)
            if isinstance(inside, BoostQuery):
                return BoostQuery(inside.query, inside.scoreBoost * boost)
            return inside if boost == 1 else BoostQuery(inside, boost)
        case ConstantScoreQuery(inner):
            return ConstantScoreQuery(normalized(inner))
        case BooleanQuery(parts, least):
            inside = [BooleanQueryPart(normalized(p.query), p.occur) for p in parts]
            if len(inside) == 1 and inside[0].occur is Occur.MUST and least == 0:
                return inside[0].query
            flat = []
            for p in inside:
                nested = p.query
                conjunction = isinstance(nested, BooleanQuery) and nested.minShouldMatch == 0 and all(q.occur in (Occur.MUST, Occur.FILTER, Occur.MUST_NOT) for q in nested.parts)
                positive = conjunction and any(q.occur is not Occur.MUST_NOT for q in nested.parts)
                flat += nested.parts if p.occur is Occur.MUST and positive else [p]
            return BooleanQuery(tuple(flat), least)
    return query
