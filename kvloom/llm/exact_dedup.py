"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. One pass turns every text into a SHA-256 digest and writes (row, id, digest),
   the row being a number of the written table.
2. Misra-Gries counters (``freqItems``, the Karp-Schenker-Papadimitriou form
   with map-side partial counters) find a superset of the digests that hold at
   least ``support`` of the rows.
3. An exact count over the digests verifies them; the winners, at most
   ``1 / support`` rows, are broadcast and settle their groups map-side.
4. The other digests, each under ``support`` of the rows, are shuffled: partial
   aggregates first, then the groups of two rows or more meet their rows.

Filtering decides over ids and hashes; texts stay where they are.

Cases: a null text counts as empty; a null id sorts after all others; of rows
that repeat both id and text exactly one is kept; a text of any length is one
digest; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import WHITE_RUN, broadcast_if, materialize

SUPPORT = 0.001
MOST_SENT = 1_000_000


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, body, text_sha256); ``body`` is xxhash64(text)."""
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), digest(F.col(text)).alias("text_sha256")),
        "digests",
    )


def _grouped(digests: DataFrame) -> DataFrame:
    """(text_sha256, keep, size): the row that stays is the one with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")).alias("keep")
    return digests.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)


def heavy_groups(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The groups of each digest that holds at least ``support`` of the rows, twice at least."""
    rows = digests.count()
    found = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    return _grouped(digests.join(F.broadcast(found), "text_sha256")).where(F.col("size") >= support * rows)


def _settled(digests: DataFrame, support: float) -> DataFrame:
    """``digests`` with keep_id, group_size and kept."""
    heavy = materialize(heavy_groups(digests, support), "heavy")
    sent = F.broadcast(heavy.select("text_sha256"))
    light = materialize(_grouped(digests.join(sent, "text_sha256", "left_anti")), "light")
    here = lambda rows, groups: rows.join(groups, "text_sha256", "left").select(
        "row",
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
        "body",
    )
    rest = digests.join(sent, "text_sha256", "left_anti")
    return here(digests.join(sent, "text_sha256", "left_semi"), F.broadcast(heavy)).unionByName(here(rest, broadcast_if(light, light.count(), MOST_SENT)))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _settled(_digests(docs, text, doc_id), support).drop("row", "body")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Rows are known by id and hash of the text.  Where those repeat in a row that
    stays, a last aggregate over just these rows takes one of them.
    """
    settled = _settled(_digests(docs, text, doc_id), support).where((F.col("group_size") > 1)).select(F.col("doc_id").alias("__kv_id"), F.col("body").alias("__kv_body"), "kept")
    known = materialize(settled.groupBy("__kv_id", "__kv_body").agg(F.max("kept").alias("__kv_kept"), F.count(F.lit(1)).alias("__kv_rows")).where(~F.col("__kv_kept") | (F.col("__kv_rows") > 1)), "copies")
    same = docs[doc_id].eqNullSafe(F.col("__kv_id")) & (F.xxhash64(docs[text]) == F.col("__kv_body"))
    met = docs.join(broadcast_if(known, known.count(), MOST_SENT), same, "left")
    left = met.where(F.col("__kv_body").isNull()).select(*[docs[c] for c in docs.columns])
    if not known.where(F.col("__kv_kept")).limit(1).count():
        return left
    again = met.where(F.col("__kv_kept")).select("__kv_id", "__kv_body", F.struct(*[docs[c] for c in docs.columns]).alias("__kv_row"))
    one = again.groupBy("__kv_id", "__kv_body").agg(F.first("__kv_row").alias("__kv_row"))
    return left.unionAll(one.select(*[F.col("__kv_row")[c].alias(c) for c in docs.columns]))
