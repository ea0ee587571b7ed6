"""Word shingles: lower-cased runs of letters and digits, five words wide.

A text of one to four words has one shingle of all its words; a text without
a word has none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5
SIMILAR = 0.8
WORD = "[\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the shingles of ``width`` words; an empty array for a shorter text."""
    at = lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)])
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    return F.array_distinct(F.when(F.size(hashes) >= width, F.transform(starts, at)).otherwise(F.array().cast("array<bigint>")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batch_shingles(flat: np.ndarray, sizes: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row, distinct shingle hash, count), sorted, from the flat word hashes (uint64) of documents of ``sizes`` words."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - width + 1, 0))
        first = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0), np.maximum(sizes - width + 1, 0)) + starts[row]
        value = np.full(len(row), np.uint64(width))
        for k in range(width):
            value = value * factor + flat[first + k]
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        brief = sizes[short].astype(np.uint64)
        for k in range(width - 1):
            has = sizes[short] > k
            brief[has] = brief[has] * factor + flat[starts[short][has] + k]
    row, value = np.r_[row, short], mix64(np.r_[value, brief])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    return row[new], value[new], np.diff(np.r_[new, len(row)])
