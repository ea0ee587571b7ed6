"""A search index that is written once and read by term.

``postings`` has a row for each (field, term, document): the term's positions
and the length of the document's field, in segments.  A segment holds a field's
postings of the documents of one task, sorted by term, so that a query reads the
row groups of its own terms and no posting is exchanged.  ``terms`` has
each (field, term) with the number of documents that hold it; ``fields`` the
documents and the average length of each field; ``documents`` the table itself,
ordered by key.

A query becomes joins of postings by key: a node gives (key, score) of the
documents that meet it, by the same rules as the compiler that scans texts.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions import text as analysis
from kvloom.functions.ranges import conjunction
from kvloom.plans import nodes as n
from kvloom.plans.compiler import K1, B, Compiler, Index, Statistics, phrase_starts, terms_of

DIGITS = 6
RUN = 1 << 21
_writing = threading.Lock()


def write_index(index: Index, path: str) -> StoredIndex:
    """Write the text fields of ``index`` and its documents under ``path``."""
    held = write_documents(index, path)
    held.inverted  # noqa: B018  writes them
    return held


def write_documents(index: Index, path: str) -> StoredIndex:
    """Write the documents of ``index`` under ``path``; its text fields follow when a query first reads one."""
    documents = index.df.repartitionByRange(index.key).sortWithinPartitions(index.key)
    documents.write.parquet(f"{path}/documents")
    return StoredIndex(index.df.sparkSession, path, index.key, index, False)


def write_inverted(index: Index, path: str) -> None:
    """Write the postings, terms and lengths of the text fields of ``index``."""
    spark, key, read = index.df.sparkSession, index.key, index.tokenised()
    repeated = not read.groupBy(key).count().where("count > 1").isEmpty()
    for i, name in enumerate(index.texts):  # a field at a time, so that the sort's prefixes are those of its terms
        rows = occurrences(read.select(F.col(key).alias("key"), F.col(Index.tokens_name(name)).alias("tokens")))
        if repeated:  # documents of one key and length are one
            rows = rows.groupBy("term", "key", "length").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        rows = rows.sortWithinPartitions("term", "key").select(F.lit(name).alias("field"), "term", "key", "length", "positions")
        rows.write.mode("append" if i else "overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    terms = held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/terms")
    each = held.where(F.get("positions", F.lit(0)) == 0).select("field", "key", "length").distinct()  # its first token stands for a document
    lengths = each.groupBy("field").agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("length"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")


def occurrences(documents: DataFrame) -> DataFrame:
    """(term, key, length, positions) of documents (key, tokens), whose terms are gathered where the document lies.

    Rows come out in sorted runs of about ``RUN`` tokens, which the sort of a segment merges.
    """
    most = RUN
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("key", documents.schema["key"].dataType), T.StructField("length", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens = batch.column(0), batch.column(1).flatten()
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                begin = ends[low] - sizes[low]
                high = max(low + 1, min(low + (1 << 18), int(np.searchsorted(ends, begin + most, "right"))))
                held = sizes[low:high]
                total, count = int(ends[high - 1] - begin), high - low
                if total:
                    coded = tokens.slice(begin, total).dictionary_encode(null_encoding="encode")
                    order = pc.array_sort_indices(coded.dictionary).to_numpy()
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    # (term, document, place) as one number of at most 63 bits
                    low_bits, mid_bits = total.bit_length(), count.bit_length()
                    packed = rank[coded.indices.to_numpy()] << (low_bits + mid_bits)
                    packed |= np.repeat(np.arange(count) << low_bits, held)
                    packed |= np.arange(total)
                    packed.sort()
                    at, pair = packed & ((1 << low_bits) - 1), packed >> low_bits
                    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                    position = (np.arange(total) - np.repeat(np.cumsum(held) - held, held)).astype(np.int32)[at]
                    pair = pair[first]
                    mine = pair & ((1 << mid_bits) - 1)
                    yield pa.record_batch(
                        [
                            coded.dictionary.take(pa.array(order[pair >> mid_bits])), keys.take(pa.array(low + mine)), pa.array(held[mine].astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.append(first, total).astype(np.int32)), pa.array(position)),
                        ],
                        names=["term", "key", "length", "positions"],
                    )
                low = high

    return documents.select("key", "tokens").mapInArrow(gather, schema)


@dataclass(frozen=True)
class StoredIndex:
    """A written index; ``source`` says how its texts are analysed."""

    spark: SparkSession
    path: str
    key: str
    source: Index
    complete: bool = True  # False while the text fields are not written

    @property
    def texts(self):
        return self.source.texts

    @property
    def inverted(self) -> str:
        """The folder of ``postings``, ``terms`` and ``fields``, written if they are not there yet."""
        with _writing:
            if not self.complete:
                write_inverted(Index(self.df, self.key, self.texts), self.path)
                object.__setattr__(self, "complete", True)
        return self.path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.source.df.schema).parquet(f"{self.path}/documents")

    @cached_property
    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.inverted}/postings")

    @cached_property
    def _terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.inverted}/terms")

    @cached_property
    def _fields(self) -> dict[str, tuple[int, float]]:
        return {r.field: (r.documents, r.length / max(1, r.documents)) for r in self.spark.read.parquet(f"{self.inverted}/fields").collect()}

    def postings(self, name: str, words: list[str]) -> DataFrame:
        """(term, key, length, positions) of the words; their row groups only are read."""
        return self._postings.where((F.col("field") == name) & F.col("term").isin(words)).select("term", "key", "length", "positions")

    def terms(self, name: str) -> DataFrame:
        """(term, df) of a text field."""
        return self._terms.where(F.col("field") == name).select("term", "df")

    def tokenised(self) -> DataFrame:
        return Index(self.df, self.key, self.texts).tokenised()

    def statistics(self, terms: set[tuple[str, str]]) -> Statistics:
        """From the terms and fields of the index."""
        asked: dict[str, list[str]] = {}
        for name, word in terms:
            if name in self.texts:
                asked.setdefault(name, []).append(word)
        holding = {(name, w): 0 for name, words in asked.items() for w in words}
        for name, words in asked.items():
            holding |= {(name, r.term): r.df for r in self.terms(name).where(F.col("term").isin(words)).collect()}
        return Statistics({f: self._fields.get(f, (0, 0.0))[0] for f in asked}, {f: self._fields.get(f, (0, 0.0))[1] for f in asked}, holding)


class Reader(Compiler):
    """Queries over a stored index."""

    index: StoredIndex

    def statistics(self, terms: set[tuple[str, str]]) -> Statistics:
        return self.index.statistics(terms)

    def found(self, query: n.Query, scores: bool = True) -> DataFrame:
        """(key, score) of the documents that meet the query."""
        self.plain = n.normalized(self.rewritten(query))
        self.stats = self.statistics(terms_of(self.plain)) if scores else Statistics({}, {}, {})
        return self._documents(self.plain)

    def _scored(self, rows: DataFrame, tf: Column, name: str, idf: float) -> DataFrame:
        average = self.stats.length.get(name) or 1.0
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average))
        return rows.select("key", (F.lit(idf) * tf / (tf + norm)).alias("score"))

    def _documents(self, query: n.Query) -> DataFrame:
        index, one = self.index, F.lit(1.0).alias("score")
        match query:
            case n.TermQuery(t) if t.field in index.texts:
                return self._scored(index.postings(t.field, [t.value]), F.size("positions"), t.field, self.stats.idf(t.field, t.value))
            case n.SynonymQuery(name, parts):
                boosts = F.coalesce(*[F.when(F.col("term") == p.term.value, F.lit(float(p.boost))) for p in parts])
                rows = index.postings(name, [p.term.value for p in parts]).groupBy("key", "length").agg(F.sum(F.size("positions") * boosts).alias("tf"))
                return self._scored(rows, F.col("tf"), name, min(self.stats.idf(p.term.field, p.term.value) for p in parts))
            case n.PhraseQuery(phrase, slop):
                return self._phrase_documents(phrase, slop)
            case n.WildcardQuery(name, pattern):
                like = F.like("term", F.lit(analysis.wildcard_like(pattern)))
                head = pattern[: min([i for i in map(pattern.find, "*?\\") if i >= 0], default=len(pattern))]
                rows = index._postings.where((F.col("field") == name) & F.startswith("term", F.lit(head)) & like)
                return rows.select("key").distinct().select("key", one)
            case n.ConstantScoreQuery(inner):
                return self._constant(inner)
            case n.BoostQuery(inner, boost):
                return self._documents(inner).select("key", (F.col("score") * F.lit(float(boost))).alias("score"))
            case n.BooleanQuery(parts, least):
                return self._combined(parts, least)
        made = self._node(query)  # no text: a condition on the documents
        return index.df.where(made.match).select(F.col(index.key).alias("key"), made.score.cast("double").alias("score"))

    def _constant(self, inner: n.Query) -> DataFrame:
        """Documents of an OR over terms of one field are read at once; there may be many."""
        parts = inner.parts if isinstance(inner, n.BooleanQuery) and inner.minShouldMatch <= 1 else ()
        terms = [p.query.term for p in parts if p.occur is n.Occur.SHOULD and isinstance(p.query, n.TermQuery)]
        if terms and len(terms) == len(parts) and len({t.field for t in terms}) == 1 and terms[0].field in self.index.texts:
            rows = self.index.postings(terms[0].field, [t.value for t in terms]).select("key").distinct()
        else:
            rows = self._documents(inner)
        return rows.select("key", F.lit(1.0).alias("score"))

    def _combined(self, parts: tuple[n.BooleanQueryPart, ...], least: int) -> DataFrame:
        of = lambda *kinds: [p for p in parts if p.occur in kinds]
        should, needed, without = of(n.Occur.SHOULD), of(n.Occur.MUST, n.Occur.FILTER), of(n.Occur.MUST_NOT)
        least = least or (1 if should and not needed else 0)
        nothing = self.index.df.limit(0).select(F.col(self.index.key).alias("key"), F.lit(0.0).alias("score"))
        if least > len(should) or not (should or needed):
            return nothing
        some = None
        if should:
            some = self._some([p.query for p in should])
            some = some.where(F.col("hits") >= least) if least > 1 else some
        rows = None
        for p in needed:
            met = self._documents(p.query)
            met = met if p.occur is n.Occur.MUST else met.select("key", F.lit(0.0).alias("score"))
            rows = met if rows is None else rows.join(met.withColumnRenamed("score", "more"), "key").select("key", (F.col("score") + F.col("more")).alias("score"))
        if rows is None:
            rows = some.select("key", "score")
        elif some is not None:
            rows = rows.join(some.withColumnRenamed("score", "more"), "key", "inner" if least else "left").select("key", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        for p in without:
            rows = rows.join(self._documents(p.query).select("key"), "key", "left_anti")
        return rows

    def _some(self, queries: list[n.Query]) -> DataFrame:
        """(key, score, hits) of the documents that meet any of the queries; terms of a field are read at once."""
        plain = lambda q: (q.query, q.scoreBoost) if isinstance(q, n.BoostQuery) else (q, 1.0)
        by_field: dict[str, list[tuple[str, float]]] = {}
        frames = []
        for q in queries:
            inner, boost = plain(q)
            if isinstance(inner, n.TermQuery) and inner.term.field in self.index.texts:
                by_field.setdefault(inner.term.field, []).append((inner.term.value, boost))
            else:
                frames.append(self._documents(q))
        for name, terms in by_field.items():
            weights = [(w, b * self.stats.idf(name, w)) for w, b in terms]
            pairs = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in weights])).alias("p")
            rows = self.index.postings(name, [w for w, _ in terms]).select("term", "key", "length", F.size("positions").alias("tf"), pairs).where(F.col("term") == F.col("p.w"))
            norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(self.stats.length.get(name) or 1.0))
            frames.append(rows.select("key", (F.col("p.x") * F.col("tf") / (F.col("tf") + norm)).alias("score")))
        return reduce(DataFrame.unionByName, frames).groupBy("key").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("hits"))

    def _phrase_documents(self, phrase: tuple[n.TermPosition, ...], slop: int) -> DataFrame:
        if not phrase:
            return self._combined((), 0)
        name, base = phrase[0].term.field, min(p.position for p in phrase)
        places = [(p.position - base, p.term.value) for p in phrase]
        distinct = sorted({t for _, t in places})
        column = {t: f"p{i}" for i, t in enumerate(distinct)}
        held = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(c) for t, c in column.items()]
        rows = self.index.postings(name, distinct).groupBy("key", "length").agg(*held).where(conjunction([F.col(c).isNotNull() for c in column.values()]))
        at, word = places[0]
        spots = F.transform(column[word], lambda p: p - at)

        def near(t: str, low: Column) -> Column:
            return F.exists(column[t], lambda p: (p >= low) & (p <= low + slop))

        def holds(i: Column) -> Column:
            return conjunction([near(t, i + a) for a, t in places])

        starts = F.filter(phrase_starts(spots, slop), lambda i: ((i >= 0) if slop == 0 else F.lit(True)) & holds(i))
        met = rows.withColumn("tf", F.size(starts)).where(F.col("tf") > 0)
        return self._scored(met, F.col("tf"), name, sum(self.stats.idf(name, t) for t in distinct))


def stored_matches(index: StoredIndex, query: n.Query, scored: bool, columns: list[str] | None = None) -> DataFrame:
    """The documents that meet the query, with ``score`` if asked; with ``columns`` that need no document, those alone."""
    found = Reader(index).found(query, scored).select(F.col("key").alias("__found"), F.round(F.col("score").cast("double"), DIGITS).alias("score"))
    found = found if scored else found.drop("score")
    if columns is not None and set(columns) <= {index.key}:
        return found.withColumnRenamed("__found", index.key)
    return index.df.join(found, F.col(index.key) == F.col("__found")).drop("__found")
