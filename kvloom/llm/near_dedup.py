"""Near-duplicate groups by ProbMinHash, banding and verification.

Similarity is the probability Jaccard of weighted word shingles, the weight of
a shingle being 1 + ln(its count).  Of documents without repeated shingles it
is the plain Jaccard similarity.

1. Signature.  Every shingle is a Poisson process with its weight as rate,
   seeded by its hash; each arrival falls into one of ``POSITIONS`` slots, and
   a slot keeps the shingle that arrives first.  A shingle is given up as soon
   as its next arrival is later than the latest slot of its document, so few
   arrivals are drawn.  Two documents agree in a slot with a probability that
   is their probability Jaccard.
2. Texts with equal shingles and counts are one node, whatever their number.  A
   node's name is a 64-bit hash; where a second hash tells two nodes of one name
   apart, both get names of 128 bits' hash instead.
3. ``BANDS`` bands of ``ROWS`` slots: at similarity 0.8 all bands miss with
   probability 0.001.  Nodes that share a band are compared with the band's
   smallest node (its pivot), never all with all.
4. Verification: the exact probability Jaccard from the whole shingle lists.
   Links join nodes to components.  In ``PASSES - 1`` further passes, bands that
   hold several components get another pivot, out of their largest component,
   and only members of other components are compared with it.
5. What pivots cannot decide: in a band that still holds two components, pairs
   of different components are verified too.  Large bands are compared in
   blocks: slots with slots, then exactly where the slots leave a doubt; only
   links come out of a block.

Components are found by label propagation with pointer jumping over the links
in tables; nothing of it is collected.

What is known of a band as a whole (its pivot, its size, whether it is open) is
written first and broadcast within ``MOST_SENT`` rows, so that the rows of a
large band need not meet in one task.

Cases: documents without a word (null, empty) link to nothing; a null id sorts
last; rows that repeat id and text are one document and stay or go together;
texts of any length are sketched whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import broadcast_if, map_batches, materialize
from kvloom.llm.shingles import SIMILAR, WORDS, batch_shingles, mix64, word_hashes

BANDS, ROWS = 30, 7
POSITIONS = BANDS * ROWS
MOST_SENT = 1_000_000
PASSES = 3
SMALL, BLOCK = 32, 512
DEVIATIONS = 6.0
CHUNK_WORDS = 200_000
BATCH_ROWS = 1_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts.astype(np.float64))


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, documents: int, positions: int = POSITIONS) -> np.ndarray:
    """(documents, positions) uint64: the shingle that arrives first in each slot; 0 for documents without shingles."""
    arrival = np.full(documents * positions, np.inf)
    first = np.zeros(documents * positions, np.uint64)
    clock = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        with np.errstate(over="ignore"):
            drawn = mix64(shingle + np.uint64(turn) * _GOLDEN)
            where = mix64(drawn ^ _GOLDEN)
        clock = clock - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        latest = arrival.reshape(documents, positions).max(axis=1)
        on = clock < latest[row]
        row, shingle, weight, clock = row[on], shingle[on], weight[on], clock[on]
        slot = row * positions + (((where[on] >> np.uint64(32)) * np.uint64(positions)) >> np.uint64(32)).astype(np.int64)
        better = clock < arrival[slot]
        slot, time, name = slot[better], clock[better], shingle[better]
        np.minimum.at(arrival, slot, time)
        won = arrival[slot] == time
        first[slot[won]] = name[won]
    return first.reshape(documents, positions)


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Exact probability Jaccard of two sorted lists of distinct shingles with their weights."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    shared = int(both.sum())
    if not shared:
        return 0.0
    if u.max() == u.min() == v.max() == v.min():
        return shared / (len(a) + len(b) - shared)
    x, y = u[both], v[at[both]]
    only_a, only_b = u.sum() - x.sum(), v.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    low = np.searchsorted(ratio, ratio, side="left")
    sum_x, sum_y = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(y)]
    return float((1.0 / ((sum_x[-1] - sum_x[low] + only_a) / x + (sum_y[low] + only_b) / y)).sum())


def _chunks(batch: pa.RecordBatch, column: int):
    """Slices of ``batch`` with the flat word hashes and word counts of each."""
    lists = batch.column(column)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, word = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, word + CHUNK_WORDS, side="right")))
        yield batch.slice(start, stop - start), flat[word : ends[stop - 1]], sizes[start:stop]
        start, word = stop, int(ends[stop - 1])


def sketch_documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, body, node, twin, bands, slots): node and twin name the shingles and counts, null without a word; bands are hashes of the bands, slots has a byte of each slot."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("body", T.LongType()), T.StructField("node", T.LongType()), T.StructField("twin", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("slots", T.BinaryType())])

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part, flat, sizes in _chunks(batch, 2):
            row, shingle, count = batch_shingles(flat, sizes)
            n = part.num_rows
            signature = signatures(row, shingle, weights_of(count), n)
            with np.errstate(over="ignore"):
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)) * _GOLDEN
                for k in range(ROWS):
                    band = mix64(band + signature[:, k::ROWS][:, :BANDS])
                names = []
                for salt in (_GOLDEN, np.uint64(0xC2B2AE3D27D4EB4F)):
                    name = np.zeros(n, np.uint64)
                    np.add.at(name, row, mix64((shingle ^ salt) + count.astype(np.uint64) * _GOLDEN))
                    names.append(mix64(name).view(np.int64))
            none = sizes == 0
            offsets = np.r_[0, np.cumsum(np.where(none, 0, BANDS))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band[~none].ravel().view(np.int64)))
            slots = pa.array([x.tobytes() for x in mix64(signature).astype(np.uint8)], pa.binary())
            out.append(pa.record_batch([part.column(0), part.column(1), *(pa.array(x, mask=none) for x in names), lists, slots], names=[f.name for f in schema]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return map_batches(docs, [F.col(doc_id), F.xxhash64(F.col(text)), word_hashes(F.col(text))], sketch, schema)


def shingle_lists(docs: DataFrame, wanted: DataFrame, rows: int, text: str, doc_id: str) -> DataFrame:
    """(node, s, n) of the documents (doc_id, body, node) in ``wanted``, which has ``rows`` rows: shingles and their counts.

    The counts are left empty if all are 1.
    """
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("s", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    keys = broadcast_if(wanted.select(F.col("doc_id").alias("wanted_id"), F.col("body").alias("wanted_body"), "node"), rows, MOST_SENT)
    here = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body"))
    met = here.join(keys, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("body") == F.col("wanted_body")))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part, flat, sizes in _chunks(batch, 1):
            row, shingle, count = batch_shingles(flat, sizes)
            rows_ = np.arange(part.num_rows + 1)
            plain = np.ones(part.num_rows, bool)
            plain[row[count > 1]] = False
            told = ~plain[row]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, rows_), pa.int32()), pa.array(shingle.view(np.int64)))
            counts = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[told], rows_), pa.int32()), pa.array(count[told].astype(np.int32)))
            out.append(pa.record_batch([part.column(0), lists, counts], names=[f.name for f in schema]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return map_batches(met, [F.col("node"), word_hashes(F.col("text"))], listed, schema).dropDuplicates(["node"])


def verified(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b), from the shingle lists of their nodes."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])
    left = lists.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"))
    right = lists.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        def rows(i: int, kind: type | None = None):
            flat, sizes = batch.column(i).flatten().to_numpy(zero_copy_only=False), batch.column(i).value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = flat.view(kind or flat.dtype), np.cumsum(sizes)
            return (flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True))

        weight = lambda s, n: weights_of(n) if len(n) else np.ones(len(s))
        out = [similarity(p, weight(p, m), q, weight(q, n)) for p, m, q, n in zip(rows(2, np.uint64), rows(3), rows(4, np.uint64), rows(5), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[f.name for f in schema])

    joined = pairs.join(left, "a").join(right, "b")
    return map_batches(joined, [F.col(c) for c in ("a", "b", "sa", "na", "sb", "nb")], measure, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without a link are left out."""
    edges = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = materialize(edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        best = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = materialize(best.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = step.select("node", "component")
        if not step.where(F.col("was") != F.col("component")).limit(1).count():
            return labels


def _sent(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written, and broadcast within the bound."""
    held = materialize(df, tag)
    return broadcast_if(held, held.count(), MOST_SENT)


def _open_bands(members: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``members``, with their components, of the bands that still hold two components."""
    placed = members.join(broadcast_if(label, label.count(), MOST_SENT), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where(F.col("c0") < F.col("c1")).select("band")
    return placed.join(_sent(open_, "openbands"), "band")


def _to_largest(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of a band's new pivot, a member of its largest component, with the members of other components."""
    sizes = placed.select("node", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    ranked = placed.select("band", "node", "component").join(_sent(sizes, "sizes"), "component")
    pivot = F.min(F.struct((-F.col("nodes")).alias("s"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("new")
    pivots = _sent(ranked.groupBy("band").agg(pivot), "pivots")
    return ranked.join(pivots, "band").where(F.col("component") != F.col("new.component")).select(F.col("new.node").alias("a"), F.col("node").alias("b")).distinct()


def _small_pairs(counted: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in the bands of up to ``SMALL`` rows."""
    small = counted.where(F.col("rows") <= SMALL)
    other = small.select("band", F.col("node").alias("b"), F.col("component").alias("other"))
    near = small.join(other, "band").where((F.col("node") < F.col("b")) & (F.col("component") != F.col("other")))
    return near.select(F.col("node").alias("a"), "b").distinct()


def _large_links(counted: DataFrame, nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of different components in the bands of over ``SMALL`` rows.

    Bands are cut into blocks of about ``BLOCK`` rows, and blocks are compared
    with blocks.  A pair is verified if its slots agree as often as the threshold
    less ``DEVIATIONS`` standard deviations of that estimate (a pair at 0.8 does
    not with a probability of 1.6e-8), in the first band that it shares, unless
    links of the block join its components already.
    """
    least = POSITIONS * threshold - DEVIATIONS * (POSITIONS * threshold * (1 - threshold)) ** 0.5
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    large = (
        counted.where(F.col("rows") > SMALL)
        .join(nodes.select("node", "slots", "bands"), "node")
        .join(lists, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "place", "block", "node", "component", "slots", "bands", "s", "n")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        slots = np.frombuffer(b"".join(rows["slots"]), np.uint8).reshape(len(rows), POSITIONS)
        bands = np.stack(rows["bands"].to_list())
        node, component, block = (rows[c].to_numpy() for c in ("node", "component", "block"))
        shingle, count = rows["s"].to_list(), rows["n"].to_list()
        place, joined, links = rows["place"].iloc[0], {}, []

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        weight = lambda i: weights_of(np.asarray(count[i])) if len(count[i]) else np.ones(len(shingle[i]))
        first = np.flatnonzero(block == rows["low"].iloc[0])
        second = np.flatnonzero(block == rows["high"].iloc[0])
        for start in range(0, len(first), 32):
            i = first[start : start + 32]
            agree = (slots[i][:, None, :] == slots[second][None, :, :]).sum(axis=2)
            x, y = np.nonzero((agree >= least) & (component[i][:, None] != component[second][None, :]))
            order = np.argsort(-agree[x, y], kind="stable")  # the likely links first: they spare others
            x, y = i[x[order]], second[y[order]]
            # a pair is taken up in the first band that it shares only, by the bands' own hashes: slots are a byte each and agree by chance
            mine = (bands[x] == bands[y]).argmax(axis=1) == place
            for p, q in zip(x[mine].tolist(), y[mine].tolist(), strict=True):
                a, b = root(component[p]), root(component[q])
                if a != b and similarity(shingle[p].view(np.uint64), weight(p), shingle[q].view(np.uint64), weight(q)) >= threshold:
                    joined[a] = b
                    links.append((min(node[p], node[q]), max(node[p], node[q])))
        return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]}, dtype=np.int64)

    return large.groupBy("band", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def _band_sizes(placed: DataFrame) -> DataFrame:
    """``placed`` with the number of rows of each band."""
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("rows"))
    return materialize(placed.join(_sent(sizes, "bandsizes"), "band").select("band", "place", "node", "component", "rows"), "open")


def _nodes(sketched: DataFrame) -> DataFrame:
    """One row a node, with one of its documents, and the least and greatest of its second hashes."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "body", "bands", "slots")).alias("one")
    grouped = sketched.where(F.col("node").isNotNull()).groupBy("node").agg(one, F.min("twin").alias("low"), F.max("twin").alias("high"))
    return materialize(grouped.select("node", "low", "high", "one.doc_id", "one.body", "one.bands", "one.slots"), "nodes")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, body, group_id (smallest doc_id of its group), group_size, kept, n_verified_links.

    ``body`` is xxhash64(text); n_verified_links counts the different texts whose
    similarity to this one was verified.  Texts that are joined already are not
    compared, so it is a lower bound of the similar texts.
    """
    sketched = materialize(sketch_documents(docs, text, doc_id), "sketches", BATCH_ROWS)
    nodes = _nodes(sketched)
    clashes = nodes.where(F.col("low") < F.col("high")).select("node")
    if clashes.limit(1).count():
        again = sketched.join(clashes.withColumn("clash", F.lit(True)), "node", "left")
        sketched = materialize(again.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "twin")).otherwise(F.col("node"))).select(*sketched.columns), "sketches")
        nodes = _nodes(sketched)
    worded = sketched.where(F.col("node").isNotNull())
    rows = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where(F.col("pivot") < F.col("last")).select("band", "pivot")
    members = materialize(rows.join(_sent(shared, "shared"), "band"), "members")
    wanted = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "body", "bands", "slots"), "wanted")
    lists = materialize(shingle_lists(docs, wanted, wanted.count(), text, doc_id), "lists", BATCH_ROWS)
    pairs = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    measured = materialize(verified(pairs, lists), "measured", BATCH_ROWS)
    links = measured.where(F.col("similarity") >= threshold).select("a", "b")
    label = components(links)
    for turn in range(1, PASSES):
        more = materialize(verified(_to_largest(materialize(_open_bands(members, label), "open"), turn), lists).where(F.col("similarity") >= threshold).select("a", "b"), "links", BATCH_ROWS)
        if not more.limit(1).count():
            continue
        links = links.unionByName(more)
        label = components(links)
    counted = _band_sizes(_open_bands(members, label))
    undecided = materialize(_small_pairs(counted), "undecided")
    near = verified(undecided, lists).where(F.col("similarity") >= threshold).select("a", "b")
    more = materialize(near.unionByName(_large_links(counted, wanted, lists, threshold)), "links", BATCH_ROWS)
    if more.limit(1).count():
        links = links.unionByName(more)
        label = components(links)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified_links"))
    known = materialize(label.join(degree, "node"), "known")
    found = worded.select("doc_id", "body", "node").join(broadcast_if(known, known.count(), MOST_SENT), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "body")).alias("head"), F.count(F.lit(1)).alias("group_size"))
    # written first: beyond the broadcast's bound, a join of its own is one that Spark can split
    large = materialize(heads.where(F.col("group_size") > 1), "heads")
    grouped = (
        found.join(broadcast_if(large, large.count(), MOST_SENT), "component", "left")
        .withColumn("alone", F.col("group_size").isNull())
        .select(
            "doc_id",
            "body",
            F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("alone") | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("body") == F.col("head.body")))).alias("kept"),
            F.coalesce("n_verified_links", F.lit(0)).cast("long").alias("n_verified_links"),
        )
    )
    blank = sketched.where(F.col("node").isNull()).select(
        "doc_id", "body", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_verified_links")
    )
    return grouped.unionByName(blank)


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns unchanged."""
    groups = near_groups(docs, text, doc_id, threshold)
    gone = materialize(groups.where(~F.col("kept")).select(F.col("doc_id").alias("__kv_id"), F.col("body").alias("__kv_body")).distinct(), "near")
    same = docs[doc_id].eqNullSafe(F.col("__kv_id")) & (F.xxhash64(docs[text]) == F.col("__kv_body"))
    return docs.join(broadcast_if(gone, gone.count(), MOST_SENT), same, "left_anti")
