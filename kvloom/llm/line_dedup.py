"""Line deduplication by probing a sharded minimal perfect hash.

1. Tasks hash the key of every line (128 bits), pre-aggregate each Arrow batch
   and emit (key hash, smallest doc, largest doc, lines); one shuffle of hashes
   merges them.  A key lies in two documents exactly if the smallest and the
   largest differ.
2. Repeated keys are dealt to shards of about ``SHARD_KEYS`` keys by hash; each
   shard becomes a minimal perfect hash (levels of collision-free bits with
   ranks) that indexes arrays of fingerprints, counts and keeping documents.
   Keys whose first halves are equal are told apart: the second and further
   ones lie in a short list beside the arrays.
3. Documents probe the arrays; lines are never joined or moved.

The arrays are broadcast only up to ``MOST_KEYS`` keys (25 bytes each).  Beyond
that bound a Bloom filter of the repeated keys (bounded by ``FILTER_BYTES``; a
larger set only passes more) is broadcast, so that lines which are not repeated
stay where they are, and the arrays of the most frequent keys, so that no shard
is hot; the hashes of the other lines are dealt to the shards and probe them
there.

Documents are compared by id; ids that are not integers are numbered in their
order first.

Cases: null text is one empty line; keys under ``MIN_POINTS`` code points
always stay; all rows with a null id count as one document that sorts last;
rows that repeat an id count as one document; a text of any length is split
whole, in time proportional to its lines; an empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import WHITE, broadcast_if, map_batches, materialize

MIN_POINTS = 10
SHARD_KEYS = 1 << 16
MOST_KEYS = 2_000_000
HEAVY = 100_000
FILTER_BYTES = 1 << 26
FILTER_BITS = 12
LINES_A_SHARD = 4_000_000
GAMMA = 2.0
LAST = np.iinfo(np.int64).max
_STRIP = WHITE.encode()
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, points: int) -> bool:
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode("utf-8", "replace")) >= points)


def _hashed_lines(texts: list[str], points: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of every text; then for each line with a key: its text's row, its number, and its 128-bit hash as two uint64."""
    lines, row, number, digests = [], [], [], []
    for i, text in enumerate(texts):
        parts = text.encode().split(b"\n")
        lines.append(parts)
        for j, part in enumerate(parts):
            key = line_key(part)
            if _long_enough(key, points):
                row.append(i)
                number.append(j)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(row, np.int64), np.array(number, np.int64), np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) of uint64 keys, another for each level."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.uint64(level + 1) * _GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys: each level keeps the keys that are alone on their bit."""

    def __init__(self, bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.bits, self.ranks = bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, ranks, placed, left = [], [], 0, keys
        while len(left):
            words = int(np.ceil(GAMMA * len(left) / 64)) + 1
            at = (mixed(left, len(bits)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64)[at] == 1
            flags = np.zeros(words * 64, np.uint8)
            flags[at[alone]] = 1
            level = np.packbits(flags, bitorder="little").view("<u8")
            counts = np.bitwise_count(level).astype(np.int64)
            bits.append(level)
            ranks.append(placed + np.cumsum(counts) - counts)
            placed += int(counts.sum())
            left = left[~alone]
        return cls(bits, ranks)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The key's number; for keys that are in no set any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, (level, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(open_):
                break
            at = mixed(keys[open_], i) % np.uint64(len(level) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (level[word] >> bit) & np.uint64(1) == 1
            below = level[word] & ((np.uint64(1) << bit) - np.uint64(1))
            hit = open_[found]
            out[hit] = (rank[word] + np.bitwise_count(below).astype(np.int64))[found]
            open_ = open_[~found]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, keep: np.ndarray, count: np.ndarray) -> bytes:
    _, first = np.unique(h1, return_index=True)
    more = np.ones(len(h1), bool)
    more[first] = False
    besides = {"more1": h1[more], "more2": h2[more], "more_keep": keep[more]}
    h1, h2, keep, count = h1[first], h2[first], keep[first], count[first]
    function = PerfectHash.build(h1)
    at = function.index(h1)
    arrays = {"fingerprint": np.empty_like(h2), "keep": np.empty_like(keep), "count": np.empty(len(h1), np.uint32)}
    arrays["fingerprint"][at], arrays["keep"][at], arrays["count"][at] = h2, keep, np.minimum(count, 0xFFFFFFFF)
    arrays |= {f"bits{i}": x for i, x in enumerate(function.bits)} | {f"ranks{i}": x for i, x in enumerate(function.ranks)}
    np.savez(out := io.BytesIO(), **arrays, **besides)
    return out.getvalue()


class Shards:
    """The broadcast form: probes arrays by shard."""

    def __init__(self, packed: dict[int, bytes], log_shards: int):
        self.packed, self.log, self.open = packed, log_shards, {}

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "log": self.log, "open": {}}

    def shard(self, i: int) -> tuple[PerfectHash, dict] | None:
        if i not in self.open:
            raw = self.packed.pop(i, None)
            if raw is None:
                self.open[i] = None
            else:
                z = np.load(io.BytesIO(raw))
                n = sum(k.startswith("bits") for k in z.files)
                self.open[i] = PerfectHash([z[f"bits{j}"] for j in range(n)], [z[f"ranks{j}"] for j in range(n)]), {k: z[k] for k in ("fingerprint", "keep", "count", "more1", "more2", "more_keep")}
        return self.open[i]

    def keepers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The document that keeps each key; -1 for keys that are not repeated."""
        out = np.full(len(h1), -1, np.int64)
        which = shard_of(h1, self.log)
        for i in np.unique(which):
            if (found := self.shard(int(i))) is None:
                continue
            rows = np.flatnonzero(which == i)
            at = found[0].index(h1[rows])
            known = at >= 0
            rows, at = rows[known], at[known]
            same = found[1]["fingerprint"][at] == h2[rows]
            out[rows[same]] = found[1]["keep"][at[same]]
            for a, b, k in zip(found[1]["more1"], found[1]["more2"], found[1]["more_keep"], strict=True):  # keys of equal first halves, hardly any
                out[(h1 == a) & (h2 == b)] = k
        return out


def shard_of(h1: np.ndarray, log_shards: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - log_shards)).astype(np.int64) if log_shards else np.zeros(len(h1), np.int64)


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS) -> DataFrame:
    """(h1, h2, keep, lines) of the keys that lie in two documents at least; keep is the smallest id."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "low", "high", "lines")])

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = _ids(batch.column(0))
        _, row, _, h = _hashed_lines([x or "" for x in batch.column(1).to_pylist()], min_points)
        if not len(row):
            return None
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, doc = h[order], ids[row[order]]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)])
        columns = [h[new, 0].view(np.int64), h[new, 1].view(np.int64), np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new), np.diff(np.r_[new, len(doc)])]
        return pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=[f.name for f in schema])

    partial = map_batches(docs, [F.col(doc_id), F.col(text)], gather, schema)
    merged = partial.groupBy("h1", "h2").agg(F.min("low").alias("keep"), F.max("high").alias("high"), F.sum("lines").alias("lines"))
    return merged.where(F.col("keep") < F.col("high")).select("h1", "h2", "keep", "lines")


def log_shards_of(keys: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


def packed_shards(repeated: DataFrame, log_shards: int) -> DataFrame:
    """(shard, packed): the arrays of each shard."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "packed": [pack_shard(h1, h2, rows["keep"].to_numpy(), rows["lines"].to_numpy())]})

    shard = F.shiftrightunsigned("h1", 64 - log_shards).cast("int") if log_shards else F.lit(0)
    return repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, "shard int, packed binary")


def build_shards(repeated: DataFrame, keys: int) -> Shards:
    """The sharded arrays of ``repeated``, which has ``keys`` rows (bounded by the caller)."""
    log_shards = log_shards_of(keys)
    return Shards({r.shard: bytes(r.packed) for r in packed_shards(repeated, log_shards).collect()}, log_shards)


def _numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, id): id is a long in the order of doc_id, null where doc_id is."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return rows.withColumn("id", F.col("doc_id").cast("long"))
    ids = materialize(rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy("doc_id").select(F.col("doc_id").alias("of"), F.monotonically_increasing_id().alias("id")), "ids")
    return rows.join(broadcast_if(ids, ids.count(), MOST_KEYS), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "id")


def _kept(lines: list[list[bytes]], row: np.ndarray, number: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Of each text, how many lines are dropped, and the others; (row, number) are the dropped lines."""
    dropped: list[set[int]] = [set() for _ in lines]
    for i, j in zip(row.tolist(), number.tolist(), strict=True):
        dropped[i].add(j)
    kept = [b"\n".join(x for j, x in enumerate(parts) if j not in out) if out else b"\n".join(parts) for parts, out in zip(lines, dropped, strict=True)]
    return [len(x) for x in dropped], kept


def _result(doc_id: pa.Array, lines: list[list[bytes]], row: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    n, kept = _kept(lines, row, number)
    return pa.record_batch([doc_id, pa.array([len(x) for x in lines], pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS, most_keys: int = MOST_KEYS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text."""
    rows = _numbered(docs, text, doc_id)
    repeated = materialize(repeated_lines(rows, "text", "id", min_points), "lines")
    keys = repeated.count()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    if keys > most_keys:
        return _by_shards(rows, repeated, keys, schema, min_points)
    shards = docs.sparkSession.sparkContext.broadcast(build_shards(repeated, keys))

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _ids(batch.column(1))
        lines, row, number, h = _hashed_lines([x or "" for x in batch.column(2).to_pylist()], min_points)
        keep = shards.value.keepers(h[:, 0], h[:, 1])
        gone = (keep >= 0) & (keep != ids[row])
        return _result(batch.column(0), lines, row[gone], number[gone])

    return map_batches(rows, [F.col("doc_id"), F.col("id"), F.col("text")], probe, schema)


def _filter_places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """(n, 4) bit numbers of keys in the Bloom filter."""
    with np.errstate(over="ignore"):
        return np.stack([(h1 + np.uint64(i) * (h2 | np.uint64(1))) % np.uint64(bits) for i in range(4)], axis=1)


def _repeated_filter(repeated: DataFrame, keys: int) -> np.ndarray:
    """A Bloom filter of the keys (h1, h2); its words are set in tasks and merged by ``bit_or``."""
    words = max(1, min(FILTER_BYTES // 8, -(-keys * FILTER_BITS // 64)))
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])

    def set_bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2 = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)).view(np.uint64) for i in (0, 1))
        at = np.unique(_filter_places(h1, h2, words * 64))
        word = at >> np.uint64(6)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), at & np.uint64(63)), first)
        return pa.record_batch([pa.array(word[first].astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    merged = map_batches(repeated, [F.col("h1"), F.col("h2")], set_bits, schema).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BYTES / 8 rows at most
    out = np.zeros(words, np.uint64)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _filter_places(h1, h2, len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(axis=1)


def _by_shards(rows: DataFrame, repeated: DataFrame, keys: int, schema: T.StructType, min_points: int) -> DataFrame:
    """Beyond the bound of the broadcast the hashes of lines that may be repeated go to the arrays.

    Hashes of lines are dealt to shards, where they stream past the shard's
    arrays, one shard in memory at a time; the numbers of dropped lines, one row
    a document, go back to their documents.
    """
    context = rows.sparkSession.sparkContext
    total = repeated.agg(F.sum("lines")).first()[0] or 0
    frequent = F.col("lines") * HEAVY >= total
    often = repeated.where(frequent)
    heavy = context.broadcast(build_shards(often, often.count()))
    maybe = context.broadcast(_repeated_filter(repeated, keys))
    log_shards = max(log_shards_of(keys), int(np.ceil(np.log2(max(1, total / LINES_A_SHARD)))))
    places = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "id", "body", "line", "h1", "h2", "gone")])

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, body = _ids(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
        _, row, number, h = _hashed_lines([x or "" for x in batch.column(1).to_pylist()], min_points)
        may = _may_hold(maybe.value, h[:, 0], h[:, 1])
        row, number, h = row[may], number[may], h[may]
        keep = heavy.value.keepers(h[:, 0], h[:, 1])
        left = (keep < 0) | (keep != ids[row])  # what a frequent key keeps is settled
        columns = [shard_of(h[:, 0], log_shards), ids[row], body[row], number, h[:, 0].view(np.int64), h[:, 1].view(np.int64), (keep >= 0).astype(np.int64)]
        return pa.record_batch([pa.array(np.ascontiguousarray(c[left]), pa.int64()) for c in columns], names=[f.name for f in places])

    lines = materialize(map_batches(rows, [F.col("id"), F.col("text"), F.xxhash64(F.col("text"))], emit, places), "hashes")
    arrays = packed_shards(repeated.where(~frequent), log_shards).select(F.col("shard").cast("long").alias("shard"), F.lit(0).alias("kind"), "packed")
    open_ = lines.where(F.col("gone") == 0).withColumn("kind", F.lit(1)).drop("gone")
    dealt = arrays.unionByName(open_, allowMissingColumns=True).select("shard", "kind", "packed", "id", "body", "line", "h1", "h2")
    found = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "body", "line")])

    def probe(batches):
        held, arrays_ = -1, None
        for batch in batches:
            shard, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if batch.num_rows else np.zeros(1, int)
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if kind[start] == 0:
                    held, arrays_, start = int(shard[start]), Shards({0: batch.column(2)[start].as_py()}, 0), start + 1
                if start == stop or held != shard[start]:
                    continue  # no repeated key in this shard
                ids, body, line, h1, h2 = (batch.column(i).slice(start, stop - start).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3, 8))
                keep = arrays_.keepers(h1.view(np.uint64), h2.view(np.uint64))
                gone = (keep >= 0) & (keep != ids)
                yield pa.record_batch([pa.array(c[gone], pa.int64()) for c in (ids, body, line)], names=[f.name for f in found])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LINES_A_SHARD)
    settled = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(probe, found)
    gone = settled.unionByName(lines.where(F.col("gone") == 1).select("id", "body", "line")).groupBy("id", "body").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone.select(F.col("id").alias("of"), F.col("body").alias("of_body"), "gone"), "gone")
    same = (F.coalesce("id", F.lit(int(LAST))) == F.col("of")) & (F.xxhash64("text") == F.col("of_body"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [(x or "").encode().split(b"\n") for x in batch.column(1).to_pylist()]
        sizes = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _result(batch.column(0), lines, np.repeat(np.arange(len(lines)), sizes), batch.column(2).flatten().to_numpy(zero_copy_only=False))

    return map_batches(rows.join(broadcast_if(gone, gone.count(), MOST_KEYS // 20), same, "left"), [F.col("doc_id"), F.col("text"), F.col("gone")], cut, schema)
