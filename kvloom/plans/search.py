"""Search requests: a query, its order, a page, and how exactly hits are counted."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.plans import nodes as n
from kvloom.plans.compiler import Compiler, Index
from kvloom.plans.stored import StoredIndex, stored_matches

DIGITS = 6


class ScoreMode(Enum):
    """Whether scores are computed: for all hits, for none, or as far as the top page needs them."""

    COMPLETE = "complete"
    COMPLETE_NO_SCORES = "complete_no_scores"
    TOP_SCORES = "top_scores"
    NO_SCORES = "no_scores"

    @property
    def scored(self) -> bool:
        return self in (ScoreMode.COMPLETE, ScoreMode.TOP_SCORES)


@dataclass(frozen=True)
class Hits:
    """One page of (key, score), and all matches for counting."""

    page: DataFrame
    matches: DataFrame
    key: str
    params: n.QueryParams

    def total(self) -> n.TotalHitsCount:
        """The exact count, or a lower bound: one more than the page needs."""
        if self.params.computePreciseHitsCount or self.params.limit is None:
            return n.TotalHitsCount(self.matches.count(), True)
        least = self.params.offset + self.params.limit + 1
        found = self.matches.limit(least).count()
        return n.TotalHitsCount(found, found < least)

    def enriched(self, values: DataFrame) -> DataFrame:
        """The page with the columns of ``values``, null where it has no such key."""
        return self.page.join(values, self.key, "left")

    def collect(self) -> list:
        """The page's rows; TimeoutError, and the jobs cancelled, after ``timeoutMilliseconds``."""
        limit = self.params.timeoutMilliseconds
        if limit is None:
            return self.page.collect()
        context, tag, fired = self.page.sparkSession.sparkContext, f"kvloom-search-{id(self)}", threading.Event()

        def stop() -> None:
            fired.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(limit / 1000, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return self.page.collect()
        except Exception as error:
            raise TimeoutError(f"over {limit} ms") from error if fired.is_set() else error
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def matches(index: Index | StoredIndex, query: n.Query, mode: ScoreMode = ScoreMode.COMPLETE, columns: list[str] | None = None) -> DataFrame:
    """All rows of the index that meet the query, with ``score`` if the mode has scores.

    ``columns`` names the columns that are needed; of a stored index the key
    alone is there without reading documents.
    """
    if isinstance(index, StoredIndex):
        return stored_matches(index, query, mode.scored, columns)
    compiler = Compiler(index)
    made = compiler.compile(query, mode.scored)
    if not compiler.used:
        found = index.df.where(made.match)
        return found.withColumn("score", F.round(made.score.cast("double"), DIGITS)) if mode.scored else found
    # one evaluation a row: a filter over a tokens column would be moved below it and tokenise again for each node
    tokens = F.struct(*[index.texts[f](F.col(f)).alias(f) for f in sorted(compiler.used)])

    def judged(row: Column) -> Column:
        inside = compiler.bound(row)
        score = F.round(inside.score.cast("double"), DIGITS) if mode.scored else F.lit(None).cast("double")
        return F.when(inside.match, F.struct(score.alias("__score")))

    kept = F.filter(F.transform(F.array(tokens), judged), lambda r: r.isNotNull())
    found = index.df.where(compiler.pushed()).select("*", F.inline(kept))
    return found.withColumn("score", F.col("__score")).drop("__score") if mode.scored else found.drop("__score")


def search(index: Index | StoredIndex, params: n.QueryParams, mode: ScoreMode | None = None) -> Hits:
    """Order, then offset and limit; the key breaks ties in every order."""
    mode = mode or (ScoreMode.COMPLETE if isinstance(params.sort, n.ScoreSort) else ScoreMode.NO_SCORES)
    needed = [index.key, params.sort.field] if isinstance(params.sort, n.NumericSort) else [index.key]
    found, key = matches(index, params.query, mode, needed), F.col(index.key)
    match params.sort:
        case n.ScoreSort():
            order = [F.col("score").desc(), key.asc()]
        case n.NumericSort(name, reverse):
            order = [F.col(name).desc() if reverse else F.col(name).asc(), key.asc()]
        case n.RandomSort(seed):
            order = [F.md5(F.concat(F.lit(seed), key.cast("string"))), key.asc()]
        case n.DocSort():
            order = [key.asc()]
        case _:
            order = []
    page = found.orderBy(*order) if order else found
    page = page.offset(params.offset) if params.offset else page
    page = page.limit(params.limit) if params.limit is not None else page
    columns = [index.key, "score"] if mode.scored else [index.key]
    return Hits(page.select(*columns), found, index.key, params)
