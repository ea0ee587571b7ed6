"""Language identification with bit-sliced Bloom filters of character n-grams.

Profile: the trigrams of a language are those with a relative frequency of at
least ``FLOOR`` in its training texts (so at most ``1 / FLOOR`` of them).

Filter: one table of ``SLOTS`` rows; a row holds one bit a language, so one
probe at ``HASHES`` rows, combined by AND, returns the bitmask of all languages
whose profile has the n-gram.  More than 64 languages take more planes.

Decision: bits are summed for each language over the n-grams of the whole
text; a language whose bits fill a share f of the table has false hits at the
rate f ** HASHES, which is taken off: (hits - rate * n) / (1 - rate).  The
largest corrected count wins, the first language by code point on a tie; the
score is its share of all corrected counts.

Training is on a bounded sample: about ``MOST_TEXTS`` texts a language, chosen
by a hash of the id.

Cases: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing could be learned; null or empty languages and null ids
are not learned from; more than ``MOST_LANGUAGES`` languages are an error (the
filter grows by 8 MB for each 64 of them); texts of any length are read whole,
in pieces whose counts are added; rows that repeat are judged separately, and
learned from as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import map_batches, materialize
from kvloom.llm.shingles import mix64

UNDETERMINED = "und"
GRAM = 3
FLOOR = 1e-5
SLOTS = 1 << 20
HASHES = 3
MOST_TEXTS = 4_000
CHUNK_CHARS = 4_000_000
MOST_LANGUAGES = 1_024


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter (2), a mark (1) or neither (0)."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, trigram) of all texts, in order, and which texts have a letter.

    Letters are lower-cased; everything else is one blank, and a blank is put
    at both ends.  Trigrams with a blank in the middle are left out, so that
    none reaches over a blank.
    """
    lowered = [x.lower() for x in texts]
    lengths = np.array([len(x) for x in lowered], np.int64)
    codes = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), "<u4")
    kind = _letters()[codes]
    codes = np.where(kind > 0, codes, np.uint32(32)).astype(np.uint64)
    lettered = np.zeros(len(texts), bool)
    row = np.repeat(np.arange(len(texts)), lengths + 2)
    lettered[row[kind == 2]] = True
    blank = codes == 32
    ok = ~blank[1:-1]
    gram = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return row[:-2][ok], gram[ok], lettered


def slots_of(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix64(gram + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    low = h & np.uint64(0xFFFFFFFF)
    return [((low + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(HASHES)]


class Profiles:
    """The filter of all languages."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages = languages
        self.planes = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
        self.false = np.zeros(len(languages))

    def insert(self, language: int, gram: np.ndarray) -> None:
        plane, bit = divmod(language, 64)
        for at in slots_of(gram, self.planes.shape[1]):
            np.bitwise_or.at(self.planes[plane], at, np.uint64(1 << bit))

    def close(self) -> Profiles:
        for i in range(len(self.languages)):
            plane, bit = divmod(i, 64)
            self.false[i] = float(((self.planes[plane] >> np.uint64(bit)) & np.uint64(1)).mean()) ** HASHES
        return self

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """(planes, n) bitmasks of the languages that have each n-gram."""
        first, *others = slots_of(gram, self.planes.shape[1])
        out = self.planes[:, first]
        for at in others:
            out &= self.planes[:, at]
        return out

    def corrected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected counts, and which texts have a letter."""
        row, gram, lettered = grams(texts)
        masks = self.masks(gram)
        total = np.bincount(row, minlength=len(texts)).astype(float)
        out = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            plane, bit = divmod(i, 64)
            has = (masks[plane] >> np.uint64(bit)) & np.uint64(1)
            hits = np.bincount(row, weights=has, minlength=len(texts))
            out[:, i] = (hits - self.false[i] * total) / max(1e-9, 1 - self.false[i])
        return out, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, lettered = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for of, part in _parts(texts):
            found, letters = self.corrected(part)
            np.add.at(counts, of, found)
            lettered[of[letters]] = True
        counts = np.maximum(counts, 0)
        best, total = counts.argmax(axis=1), counts.sum(axis=1)
        share = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-300), 1 / len(self.languages))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, share, 0.0)


def _pieces(text: str):
    """The text in pieces of CHUNK_CHARS at most, cut behind the last character that is no letter (a longer run of letters is cut where it is full)."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        kind = _letters()[np.frombuffer(text[start : start + CHUNK_CHARS].encode("utf-32-le"), "<u4")]
        blank = np.flatnonzero(kind == 0)
        stop = start + (int(blank[-1]) + 1 if len(blank) else CHUNK_CHARS)
        yield text[start:stop]
        start = stop
    yield text[start:]


def _parts(texts: list[str]):
    """Lists of pieces of about CHUNK_CHARS, with the numbers of their texts."""
    of, part, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if part and size + len(piece) > CHUNK_CHARS:
                yield np.array(of, np.int64), part
                of, part, size = [], [], 0
            of.append(i)
            part.append(piece)
            size += len(piece)
    if part:
        yield np.array(of, np.int64), part


def learn(training: DataFrame, most_texts: int = MOST_TEXTS) -> Profiles:
    """Profiles from the rows (doc_id, text, lang) of ``training``."""
    counted = training.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    languages = [r.lang for r in counted]
    if not languages:
        return Profiles([]).close()
    numbers = {x: i for i, x in enumerate(languages)}
    shares = training.sparkSession.createDataFrame([(r.lang, min(1.0, most_texts / r.texts)) for r in counted], "lang string, share double")
    chosen = training.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    schema = T.StructType([T.StructField("language", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        names = np.array([numbers[x] for x in batch.column(0).to_pylist()], np.int64)
        for of, part in _parts([x or "" for x in batch.column(1).to_pylist()]):
            row, gram, _ = grams(part)
            language = names[of[row]]
            for i in np.unique(language):
                g, n = np.unique(gram[language == i], return_counts=True)
                found.append((np.full(len(g), i, np.int32), g.view(np.int64), n))
        if not found:
            return None
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=[f.name for f in schema])

    counts = materialize(map_batches(chosen, [F.col("lang"), F.col("text")], count, schema).groupBy("language", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "language").withColumn("rate", F.col("n") / F.col("total"))
    kept = rates.where(F.col("rate") >= FLOOR).select("language", "gram")
    profiles = Profiles(languages)
    for language, gram in kept.groupBy("language").agg(F.collect_list("gram")).toLocalIterator():  # at most 1 / FLOOR n-grams a language
        profiles.insert(language, np.array(gram, np.int64).view(np.uint64))
    return profiles.close()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", most_texts: int = MOST_TEXTS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Learns from the rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    training = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.coalesce("lang", F.lit("")) != "") & F.col("text").isNotNull())
    profiles = docs.sparkSession.sparkContext.broadcast(learn(training, most_texts))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores = profiles.value.predict([x or "" for x in batch.column(2).to_pylist()])
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores)], names=[f.name for f in schema])

    return map_batches(rows, [F.col("doc_id"), held_out(F.col("doc_id")), F.col("text")], predict, schema)
