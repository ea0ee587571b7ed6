"""Benchmark decontamination by containment search (DataFrame functions only).

Test items are short and documents long, so a symmetric sketch of whole
documents cannot find them.  The search is for containment instead:

1. Items are partitioned by size, class c holding 2**c to 2**(c+1) - 1 distinct
   shingles.  The MinHash sketch of an item is its smallest shingle hashes; each
   class has its own sketch size, ``HITS`` more than a contained item of the
   class can miss: of an item of n shingles that is contained by the threshold
   t at least, (1 - t) n shingles are missing at most.  So a document that
   contains it holds ``HITS`` of the sketch at least (for small items, whose
   sketch is the whole item, t n): no item is lost by sketching.
2. One pass over the documents probes the distinct shingles of every whole text
   in the sketches.  Hits are counted map-side for each (document, item); pairs
   with enough hits are candidates.
3. The candidates' documents are shingled again and the exact containment
   |D & I| / |I| decides.

Cases: null text or an item without a word matches nothing; an item under five
words is one shingle of all its words; texts of any length are probed whole;
rows that repeat id and text are one document; a null id is an id of its own; equal items all match; an empty
table of either kind gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import broadcast_if, materialize
from kvloom.llm.shingles import SIMILAR, WORDS, shingle_hashes, word_hashes

HITS = 12
MOST_SENT = 1_000_000


def item_shingles(items: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WORDS) -> DataFrame:
    """(item_id, width, n_item, h): the distinct shingles of every item."""
    hashed = items.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(text)).alias("item_body"), word_hashes(F.col(text)).alias("w"))
    parts = F.array(*[F.when(F.size("w") == k, shingle_hashes(F.col("w"), k)).otherwise(F.array().cast("array<bigint>")) for k in range(1, width)])
    own = F.when(F.size("w") >= width, shingle_hashes(F.col("w"), width)).otherwise(F.flatten(parts))
    return (
        hashed.select("item_id", "item_body", F.least(F.size("w"), F.lit(width)).alias("width"), own.alias("s"))
        .distinct()
        .select("item_id", "item_body", "width", F.size("s").cast("long").alias("n_item"), F.explode("s").alias("h"))
    )


def sketches(shingles: DataFrame, threshold: float, hits: int = HITS) -> DataFrame:
    """(item_id, item_body, h, need): the sketch of every item, and the hits that make a candidate."""
    lists = shingles.groupBy("item_id", "item_body", "n_item").agg(F.sort_array(F.collect_list("h")).alias("all"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1  # of the size class
    size = F.least(F.col("n_item"), F.floor((1 - threshold) * largest + 1e-9) + hits).cast("int")
    need = F.greatest(F.lit(1), size - F.floor((1 - threshold) * F.col("n_item") + 1e-9))
    return lists.select("item_id", "item_body", need.cast("long").alias("need"), F.explode(F.slice("all", F.lit(1), size)).alias("h"))


def _probed(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, body, h): the distinct shingles of every document, of each width in the list."""
    every = F.flatten(F.array(*[shingle_hashes(F.col("w"), k) for k in widths])) if widths else F.array().cast("array<bigint>")
    return docs.select("doc_id", "body", word_hashes(F.col("text")).alias("w")).select("doc_id", "body", F.explode(every).alias("h"))


def contaminated_pairs(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = SIMILAR) -> DataFrame:
    """One row per document and item with containment >= threshold: doc_id, body, item_id, n_shared, n_item, containment.

    ``body`` is xxhash64(text).
    """
    shingles = materialize(item_shingles(items, item_text, item_id), "items")
    sketch = materialize(sketches(shingles, threshold), "sketches")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # five values at most
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body"))
    pair = ["doc_id", "body", "item_id", "item_body"]
    candidates = materialize(
        _probed(corpus, widths)
        .join(broadcast_if(sketch, sketch.count(), MOST_SENT), "h")
        .groupBy(*pair, "need")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= F.col("need"))
        .select(*pair),
        "candidates",
    )
    found = candidates.select(F.col("doc_id").alias("found_id"), F.col("body").alias("found_body")).distinct()
    again = corpus.join(broadcast_if(found, candidates.count(), MOST_SENT), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("body") == F.col("found_body")), "left_semi")
    counted = (
        _probed(again, widths)
        .join(broadcast_if(shingles, shingles.count(), MOST_SENT), "h")
        .groupBy(*pair, "n_item")
        .agg(F.countDistinct("h").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    )
    wanted = candidates.select(*[F.col(c).alias(f"wanted_{c}") for c in pair])
    same = [F.col(c).eqNullSafe(F.col(f"wanted_{c}")) for c in pair]
    return counted.join(wanted, same[0] & same[1] & same[2] & same[3], "left_semi").select(
        "doc_id", "body", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns unchanged."""
    pairs = contaminated_pairs(docs, items, text, doc_id, item_text, item_id, threshold)
    hit = materialize(pairs.select(F.col("doc_id").alias("__kv_id"), F.col("body").alias("__kv_body")).distinct(), "contaminated")
    same = docs[doc_id].eqNullSafe(F.col("__kv_id")) & (F.xxhash64(docs[text]) == F.col("__kv_body"))
    return docs.join(broadcast_if(hit, hit.count(), MOST_SENT), same, "left_anti")
