"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Targets: every source asks for a share of the budget in proportion to its
weight, but never for more than ``max_epochs`` times its size; what is clamped
is shared out again by weight until no source is above its cap.  The fixed
point is found in closed form over the table of sources: sorted by
cap / weight, the clamped sources are a prefix.

Sampling: a document is taken ``floor(target / source_size)`` times whole; the
remaining fraction of an epoch is a seeded random order of the source's
documents, taken until the remainder is reached (a document whose midpoint
lies within it is taken).  The order is that of ``md5(seed, id, text)``, in which
rows tie only if id and text are equal, so that reruns agree.  What is taken is
a prefix of the order, so one place a source, the cut, decides every row: sums
over ``16 ** BUCKET_DIGITS`` buckets of places find the bucket of the cut, and
only that bucket is sorted.  Rows are never shuffled.

Cases: null text has size 0 and takes 0, and no document, empty ones included,
is repeated more than ``max_epochs`` times; the null source is a source of its
own and comes last; with all sizes 0 every target is 0; null ids are ordered by
their texts; rows that repeat an id are taken separately, and rows that repeat
id and text are taken or left together; a text of any length is one row; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.common import WORD_RUN, broadcast_if, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_DIGITS = 3
MOST_SOURCES_SENT = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_no, source, source_size, target) for the rows (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long")
    sources = (
        sizes.withColumn("source_no", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_no").asc())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = (
        sources.withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every))
        .withColumn("free", F.col("budget") - F.col("below"))
        .withColumn("position", F.row_number().over(by_ratio))
        .withColumn("holds", F.col("free") * F.col("weight") <= F.col("cap") * F.col("open"))
    )
    level = F.min(F.when(F.col("holds"), F.struct("position", "free", "open"))).over(every)
    share = F.col("level.free").cast("double") * F.col("weight") / F.col("level.open")
    return steps.withColumn("level", level).select(
        "source_no", "source", "source_size", F.when(F.col("level").isNull() | (share > F.col("cap")), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _measured(docs: DataFrame, text: str, doc_id: str, source: str, seed: str) -> DataFrame:
    """``docs`` with __kv_source, __kv_size and __kv_place, the seeded random place."""
    of = [F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))]
    return docs.withColumns({"__kv_source": F.col(source), "__kv_size": word_count(F.col(text)), "__kv_place": F.md5(F.concat_ws("|", *of))})


def _decided(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``rows``, as _measured() gives them, with __kv_total, __kv_target and __kv_repeats; ``sized`` has the measures of the same rows."""
    bucket = F.substring("__kv_place", 1, BUCKET_DIGITS)
    held = materialize(sized.groupBy(F.col("__kv_source").alias("source"), bucket.alias("bucket")).agg(F.sum("__kv_size").alias("held")), "buckets")
    totals = held.groupBy("source").agg(F.sum("held").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialize(targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    count, none = targets.count(), F.lit(0).cast("long")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("start", F.coalesce(F.sum("held").over(earlier), none)).withColumnRenamed("source", "of")
    at_cut = (
        starts.join(broadcast_if(targets, count, MOST_SOURCES_SENT), F.col("of").eqNullSafe(F.col("source")))
        .where(F.col("start") <= F.col("left"))
        .groupBy("source_no", "source", "left")
        .agg(F.max(F.struct("bucket", "start")).alias("last"))
        .select("source_no", "source", "left", F.col("last.bucket").alias("bucket"), F.col("last.start").alias("start"))
    )
    at_cut = materialize(at_cut, "cuts")
    inside = Window.partitionBy("source_no").orderBy("__kv_place", "__kv_size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("__kv_size").over(inside), none) + F.col("__kv_size") / F.lit(2.0)
    cuts = (
        sized.join(broadcast_if(at_cut, count, MOST_SOURCES_SENT), F.col("__kv_source").eqNullSafe(F.col("source")) & (bucket == F.col("bucket")))
        .withColumn("middle", middle)
        .groupBy("source_no", "bucket")
        .agg(F.max(F.when(F.col("middle") <= F.col("left"), F.col("__kv_place"))).alias("place"))
        .select("source_no", F.coalesce("place", "bucket").alias("__kv_cut"))
    )
    sources = materialize(targets.join(cuts, "source_no", "left"), "sources").select(
        F.col("source").alias("__kv_name"), F.col("source_size").alias("__kv_total"), F.col("target").alias("__kv_target"), F.col("whole").alias("__kv_whole"), "__kv_cut"
    )
    extra = (F.col("__kv_place") <= F.col("__kv_cut")) & (F.col("__kv_whole") < max_epochs)
    return rows.join(broadcast_if(sources, count, MOST_SOURCES_SENT), F.col("__kv_source").eqNullSafe(F.col("__kv_name"))).withColumn(
        "__kv_repeats", F.col("__kv_whole") + F.when(extra, 1).otherwise(0)
    )


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    measured = _measured(docs, text, doc_id, source, seed)
    sized = materialize(measured.select(F.col(doc_id).alias("__kv_id"), "__kv_source", "__kv_size", "__kv_place"), "sizes")
    return _decided(sized, sized, weights, max_epochs).select(
        F.col("__kv_id").alias("doc_id"),
        F.col("__kv_source").alias("source"),
        F.col("__kv_size").alias("size"),
        F.col("__kv_total").alias("source_size"),
        F.col("__kv_target").alias("target"),
        (F.col("__kv_size") * F.col("__kv_repeats")).alias("taken"),
    )


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the input columns of every document that is taken, with ``mix_size``, ``mix_target``, ``mix_taken`` and ``mix_repeats``.

    Input columns of those four names are replaced.
    """
    measured = _measured(docs, text, doc_id, source, seed)
    sized = materialize(measured.select("__kv_source", "__kv_size", "__kv_place"), "sizes")
    own = ["mix_size", "mix_target", "mix_taken", "mix_repeats"]
    return (
        _decided(measured, sized, weights, max_epochs)
        .where(F.col("__kv_repeats") > 0)
        .select(
            *[F.col(c) for c in docs.columns if c not in own],
            F.col("__kv_size").alias("mix_size"),
            F.col("__kv_target").alias("mix_target"),
            (F.col("__kv_size") * F.col("__kv_repeats")).alias("mix_taken"),
            F.col("__kv_repeats").alias("mix_repeats"),
        )
    )
