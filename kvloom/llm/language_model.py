"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens are ASCII-lower-cased words and one end token a text.  Texts are read as
bytes, in segments of ``SEGMENT`` bytes cut between words, and turned into
128-bit token hashes by array arithmetic; a token is known by its hash.

Counts.  Tasks tally the tokens of all texts; one shuffle merges them into the
whole vocabulary: N tokens and V distinct ones in training texts.  The most
frequent tokens of all texts, ``SENT`` at most, are broadcast with their
counts.  The others meet their counts in a join; each is rarer than any token
that is sent, so none of them is a hot key.

Model.  The vocabulary is a nest of classes, each split into ``BRANCHES``.  The
first split is by frequency rank: class k holds 8 ** (k + 1) sent tokens, the
last one all other tokens.  Inside, tokens are split by the digits of their
rank, those not sent by digits of their hash (``LEAVES`` leaves; within a leaf
a token has its share of the counts).  P(token | h) is the product of the
softmaxes on the way to the token: P(class | h) P(subclass | class, h) and so on.
Each softmax sums weights of hashed features of the history h: the word before,
the word before that (a skip), and both (an n-gram), each joined with the
class.  Features are hashes of the words themselves, so every word is its own
history, and they act on every token of the vocabulary.  Unknown tokens have a
branch of their own with one unit of the base's distribution.

Training.  Weights start at the smoothed unigram distribution, which is the
base.  ``ROUNDS`` times, tasks take the current weights, run stochastic gradient
steps (Adagrad) on all positions of their share of the training texts, and give
back the changes; a weight moves by the mean over the tasks that changed it.
Every training text takes part in one round.  Sums over tasks are streamed block
by block, in two levels.

Scoring runs in numpy over sparse batches: the (position, class) pairs on the
way to the tokens of a segment, with the numbers of their features' weights.

Cases: a null text is the end token alone; a null id is never learned from and
not held out; rows that repeat are counted and scored separately; a text of any
length, and a word of any length, is read whole, a segment at a time; tokens of
equal counts are ranked by hash; without training texts N and V are 0 and every
token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import materialize, ship_package
from kvloom.llm.shingles import mix64

LOG_BRANCHES = 3
BRANCHES = 1 << LOG_BRANCHES
SENT = 1 << 20
TAIL, UNKNOWN = BRANCHES - 1, BRANCHES
#: Digits of the codes inside each class, the first rank of each class, and its branch of the root.
DIGITS = np.array([*range(1, BRANCHES), BRANCHES - 2, 1], np.int32)
FIRST_RANK = np.cumsum([0] + [BRANCHES**k for k in range(1, BRANCHES)])
BRANCH = np.array([*range(BRANCHES), TAIL], np.int32)
LEAVES = BRANCHES ** int(DIGITS[TAIL])
FIRST_LEAF = LEAVES // BRANCHES
WEIGHT_BITS = 17
FEATURES = 3
ROUNDS = 3
RATE = 0.1
FIRST_SUM = 0.1
BATCH = 4_096
SEGMENT = 1 << 16
LONG = 1 << 12
TALLY = 1 << 19
BATCH_ROWS = 1_000
BLOCK = 1 << 14
START = np.uint64(0)


def _numbering() -> tuple[np.ndarray, int]:
    """What numbers a node: an offset for each class and number of digits still to come, to be added to the digits before."""
    offsets, nodes = np.zeros((len(DIGITS), int(DIGITS.max()) + 2), np.int32), 1
    for k, digits in enumerate(DIGITS[:UNKNOWN].tolist()):
        for i in range(digits):
            offsets[k, digits - i] = nodes - (k << LOG_BRANCHES * i)
            nodes += BRANCHES**i
    offsets[UNKNOWN, 1] = offsets[TAIL, DIGITS[TAIL]]
    return offsets, nodes


OFFSETS, NODES = _numbering()

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += _U(32)
_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = [mix64((_FOLDED + _U(1)) * _U(salt)) for salt in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_END = (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F))
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if not _powers:
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(SEGMENT + 1, _U(factor))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


@dataclass
class Tokens:
    """Tokens of a segment: the row of each one's text, its hash, and the (first half of) hashes one and two positions back."""

    row: np.ndarray
    name: np.ndarray
    twin: np.ndarray
    before: np.ndarray
    skip: np.ndarray

    def __getitem__(self, at) -> Tokens:
        return Tokens(self.row[at], self.name[at], self.twin[at], self.before[at], self.skip[at])


def _cut(data: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """The end of the segment from ``start``: between words, behind a word longer than a segment."""
    stop = start + SEGMENT
    if stop >= len(data):
        return len(data)
    blank = np.flatnonzero(_IS_WHITE[data[start + 1 : stop + 1]])
    text = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
    cut = max(text, start + 1 + int(blank[-1]) if len(blank) else 0)
    if cut > start:
        return cut
    ends = int(offsets[np.searchsorted(offsets, stop, side="right")])
    blank = np.flatnonzero(_IS_WHITE[data[stop:ends]])
    return stop + int(blank[0]) if len(blank) else ends


def _names(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Both halves of the hashes of the words data[first:last]."""
    size = last - first
    out = [np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)]
    if len(data) <= SEGMENT:
        power, inverse = _power_tables()
        at, sums, undo = data.astype(np.intp), np.zeros(len(data) + 1, np.uint64), np.take(inverse, first)
        with np.errstate(over="ignore"):
            for half, values in zip(out, _BYTES, strict=True):
                terms = np.take(values, at, mode="clip")
                terms *= power[: len(data)]
                np.cumsum(terms, out=sums[1:])
                half[:] = mix64((np.take(sums, last) - np.take(sums, first)) * undo + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG).tolist():  # powers modulo 2**64 collide in very long words
        word = _FOLDED[data[first[i] : last[i]]].astype(np.uint8)
        out[0][i], out[1][i] = np.frombuffer(xxhash.xxh3_128_digest(word), "<u8")
    return out


def read(column: pa.Array) -> Iterator[Tokens]:
    """The tokens of all texts of a column, segment by segment."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    start, ended, held = 0, 0, (np.zeros(2, np.uint64), np.full(2, -1))
    while ended < len(texts):
        stop = _cut(data, offsets, start)
        here = data[start:stop]
        white = (here == 32) | ((here >= 9) & (here <= 13))
        edge = starts_text[start : stop + 1].copy()
        edge[[0, -1]] = True
        first = np.flatnonzero(~white & (edge[:-1] | np.r_[True, white[:-1]][: len(white)]))
        last = np.flatnonzero(~white & (edge[1:] | np.r_[white[1:], True][: len(white)])) + 1
        words = np.searchsorted(first, np.clip(offsets[ended:] - start, 0, stop - start))
        row = np.repeat(np.arange(ended, len(texts)), np.diff(words))
        ends = len(texts) if stop == len(data) else int(np.searchsorted(offsets[1:], stop, side="right"))
        closed = np.arange(ended, ends)
        at = np.arange(len(first)) + (row - ended)
        at_end = np.searchsorted(row, closed, side="right") + (closed - ended)
        names = []
        for half, end in zip(_names(data[start:stop], first, last), _END, strict=True):
            flat = np.empty(len(first) + len(closed), np.uint64)
            flat[at], flat[at_end] = half, end
            names.append(flat)
        rows = np.empty(len(names[0]), np.int64)
        rows[at], rows[at_end] = row, closed
        earlier, of = np.r_[held[0], names[0]], np.r_[held[1], rows]
        yield Tokens(rows, names[0], names[1], np.where(of[1:-1] == rows, earlier[1:-1], START), np.where(of[:-2] == rows, earlier[:-2], START))
        held, start, ended = (earlier[-2:], of[-2:]), stop, ends


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tally(name: np.ndarray, twin: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes with the sums of their counts."""
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    if (same & (twin[order][1:] != twin[order][:-1])).any():
        order = np.lexsort((twin, name))
        same = (name[order][1:] == name[order][:-1]) & (twin[order][1:] == twin[order][:-1])
    new = np.flatnonzero(np.r_[True, ~same]) if len(order) else order
    return [name[order[new]], twin[order[new]], *(np.add.reduceat(c[order], new) if len(order) else c for c in counts)]


class Names:
    """An open-addressing table of token hashes; gives their ranks."""

    def __init__(self, name: np.ndarray, twin: np.ndarray):
        self.name, self.twin = name, twin
        self.bits = max(4, int(len(name)).bit_length() + 1)
        self.table = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(name), dtype=np.int32)[::-1]  # of two tokens for a place the more frequent one has it
        at = self.home(name[left])
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            out = self.table[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.table) - 1)

    def home(self, name: np.ndarray) -> np.ndarray:
        return (name >> _U(64 - self.bits)).astype(np.int64)

    def ranks(self, name: np.ndarray, twin: np.ndarray) -> np.ndarray:
        """Ranks, -1 for tokens that are not in the table."""
        out = np.full(len(name), -1, np.int64)
        if not len(self.name):
            return out
        at, open_ = self.home(name), None
        while open_ is None or len(open_):
            a, b = (name, twin) if open_ is None else (name[open_], twin[open_])
            rank = self.table[at]
            same = (rank >= 0) & (self.name[rank] == a) & (self.twin[rank] == b)
            more = np.flatnonzero((rank >= 0) & ~same)
            if open_ is None:
                out[same] = rank[same]
                open_ = more
            else:
                out[open_[same]] = rank[same]
                open_ = open_[more]
            at = (at[more] + 1) & (len(self.table) - 1)
        return out


def leaf_of(twin: np.ndarray) -> np.ndarray:
    """The leaves of tokens that are not sent; those under FIRST_LEAF belong to unknown tokens."""
    return ((twin >> _U(40)) % _U(LEAVES - FIRST_LEAF)).astype(np.int32) + np.int32(FIRST_LEAF)


class Vocabulary:
    """The sent tokens by rank with their training counts, and the counts + 1 summed over the leaves of the tail."""

    def __init__(self, name: np.ndarray, twin: np.ndarray, counts: np.ndarray, leaves: np.ndarray, total: int):
        self.name, self.twin, self.counts, self.leaves, self.total = name, twin, counts, leaves, total
        self.known = int((counts > 0).sum())
        self._names: Names | None = None
        self._classes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_names": None, "_classes": None}

    def ranks(self, t: Tokens) -> np.ndarray:
        if self._names is None:
            self._names = Names(self.name, self.twin)
        return self._names.ranks(t.name, t.twin)

    def places(self, t: Tokens) -> Places:
        rank = self.ranks(t)
        class_ = np.take(self.class_of_rank(), rank, mode="wrap")
        inner = (rank - np.take(FIRST_RANK, class_, mode="clip")).astype(np.int32)
        away = np.flatnonzero(rank < 0)
        inner[away], class_[away] = leaf_of(t.twin[away]), TAIL
        inner[class_ == UNKNOWN] = 0
        return Places(rank, class_, inner)

    def class_of_rank(self) -> np.ndarray:
        if self._classes is None:
            self._classes = np.repeat(np.arange(TAIL, dtype=np.int32), np.diff(FIRST_RANK))[: len(self.counts) + 1]
            self._classes[self.known :] = UNKNOWN
        return self._classes

    def biases(self) -> np.ndarray:
        """(NODES, BRANCHES): the logs of the shares of a node's branches in its sum of (count + 1)."""
        out, classes = np.zeros((NODES, BRANCHES), np.float32), np.zeros(BRANCHES)
        for k in range(BRANCHES):
            digits = int(DIGITS[k])
            m = np.zeros(BRANCHES**digits)
            if k == TAIL:
                m[FIRST_LEAF:], m[0] = self.leaves[FIRST_LEAF:], 1.0  # unknown tokens have the first branch
            else:
                held = self.counts[: self.known][FIRST_RANK[k] : FIRST_RANK[k + 1]]
                m[: len(held)] = held + 1.0
            classes[k] = m.sum()
            for i in range(digits - 1, -1, -1):
                first = OFFSETS[k, digits - i] + (k << LOG_BRANCHES * i)
                out[first : first + BRANCHES**i] = _log_shares(m)
                m = m.reshape(-1, BRANCHES).sum(axis=1)
        out[:1] = _log_shares(classes)
        return out


def _log_shares(mass: np.ndarray) -> np.ndarray:
    mass = mass.reshape(-1, BRANCHES)
    return np.log(np.maximum(mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-30), 1e-20))


@dataclass
class Places:
    """Where tokens are in the model: rank (-1: not sent), class, and code within the class, of ``DIGITS`` digits."""

    rank: np.ndarray
    class_: np.ndarray
    inner: np.ndarray

    def __getitem__(self, at) -> Places:
        return Places(self.rank[at], self.class_[at], self.inner[at])


def features(before: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of the histories' features; inputs are hashes of tokens, or START."""
    with np.errstate(over="ignore"):
        keys = [before ^ _U(1), skip * _U(5), (before * _U(_BASE) + skip) ^ _U(3)]
        return [((x * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32) for x in keys]


class Decisions:
    """The branchings on the way to tokens: one (position, node, branch) each, and the hashed weights of its features."""

    def __init__(self, places: Places, f: list[np.ndarray]):
        digits = np.take(DIGITS, places.class_, mode="clip")
        self.depth = digits + 1
        full = (np.take(BRANCH, places.class_, mode="clip") << LOG_BRANCHES * digits) | places.inner
        ends = np.cumsum(self.depth, dtype=np.int32)
        self.starts = ends - self.depth
        of = np.repeat(np.arange(len(ends)), self.depth)
        left = np.take(ends, of, mode="clip")
        left -= np.arange(len(left), dtype=np.int32)
        node = np.take(OFFSETS.ravel(), np.take(places.class_ * OFFSETS.shape[1], of, mode="clip") + left, mode="clip")
        left *= LOG_BRANCHES
        code = np.take(full, of, mode="clip")
        node += code >> left
        left -= LOG_BRANCHES
        code >>= left
        code &= BRANCHES - 1
        self.node, self.branch = node, code
        with np.errstate(over="ignore"):
            salt = node.view(np.uint32) * np.uint32(0x9E3779B1)
            self.weights = []
            for x in f:
                key = np.take(x, of, mode="clip")
                key ^= salt
                key *= np.uint32(0x85EBCA6B)
                key >>= np.uint32(32 - WEIGHT_BITS)
                self.weights.append(key.astype(np.intp))

    def odds(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits of all branches, and their sums."""
        z = np.take(model.bias, self.node, axis=0, mode="clip")
        for at in self.weights:
            z += np.take(model.weights, at, axis=0, mode="clip")
        np.exp(z, out=z)
        return z, z @ np.ones(BRANCHES, np.float32)


@dataclass
class Model:
    """Hashed weights, (2 ** WEIGHT_BITS, BRANCHES), and the start's biases."""

    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        return cls(np.zeros((1 << WEIGHT_BITS, BRANCHES), np.float32), vocabulary.biases())

    def flat(self) -> np.ndarray:
        return self.weights.ravel()

    def moved(self, flat: np.ndarray) -> Model:
        return Model(flat.reshape(self.weights.shape), self.bias)

    def log_probabilities(self, places: Places, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural logs of P(token | h); for the tail those of the leaf."""
        out = np.empty(len(before))
        for start in range(0, len(before), BATCH):
            part = slice(start, start + BATCH)
            d = Decisions(places[part], features(before[part], skip[part]))
            z, total = d.odds(self)
            p = np.take(z.ravel(), np.arange(0, z.size, BRANCHES) + d.branch, mode="clip")
            p /= total
            out[part] = np.add.reduceat(np.log(p), d.starts)
        return out


class Steps:
    """Gradient steps on a copy of the model."""

    def __init__(self, model: Model):
        self.model, self.sums = Model(model.weights.copy(), model.bias), np.full(1 << WEIGHT_BITS, FIRST_SUM, np.float32)
        self.seen = 0

    def step(self, places: Places, before: np.ndarray, skip: np.ndarray) -> None:
        model = self.model
        self.seen += len(before)
        d = Decisions(places, features(before, skip))
        error, total = d.odds(model)
        error /= total[:, None]
        error.reshape(-1)[np.arange(0, error.size, BRANCHES) + d.branch] -= 1
        square = np.square(error) @ np.ones(BRANCHES, np.float32)
        # subtract.at takes a time by the index: two neighbouring floats are a complex number, for the same sums at half the indices
        pairs, move, numbers = model.weights.reshape(-1).view(np.complex64), np.empty_like(error), np.empty((len(error), BRANCHES // 2), np.intp)
        for at in d.weights:
            np.add.at(self.sums, at, square)
            scale = np.take(self.sums, at, mode="clip")
            np.divide(np.float32(RATE), np.sqrt(scale, out=scale), out=scale)
            np.multiply(error, scale[:, None], out=move)
            np.multiply(at, BRANCHES // 2, out=numbers[:, 0])
            for i in range(1, BRANCHES // 2):
                np.add(numbers[:, 0], i, out=numbers[:, i])
            np.subtract.at(pairs, numbers.ravel(), move.reshape(-1).view(np.complex64))

    def learn(self, texts: pa.Array, vocabulary: Vocabulary) -> None:
        """Steps at every position of ``texts``; each batch of steps is spread over its segment."""
        for t in read(texts):
            places = vocabulary.places(t)
            batches = -(-len(t.row) // BATCH)
            for i in range(batches):
                at = slice(i, None, batches)
                self.step(places[at], t.before[at], t.skip[at])


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def count_tokens(rows: DataFrame) -> DataFrame:
    """(name, twin, c, every) from the rows (text, training): occurrences in training texts and in all."""
    schema = T.StructType(_longs("name", "twin", "c", "every"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if batch.num_rows else None
            for t in read(batch.column(0)):
                held.append(tally(t.name, t.twin, training[t.row], np.ones(len(t.row), np.int64)))
                if sum(len(x[0]) for x in held) > TALLY:
                    held = [tally(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > TALLY // 2:
                        yield packed(held.pop())
        if held:
            yield packed(tally(*map(np.concatenate, zip(*held, strict=True))))

    def packed(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c.view(np.int64)) for c in columns], names=[f.name for f in schema])

    return rows.select("text", "training").mapInArrow(count, schema).groupBy("name", "twin").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def sent_from(counts: DataFrame) -> int:
    """The least number of occurrences of the tokens that are sent: as many as fit in SENT."""
    step = F.when(F.col("every") < BATCH, F.col("every")).otherwise(F.expr("shiftleft(1L, int(floor(log2(every))))"))
    held, least = 0, 1 << 62
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # BATCH + 52 rows at most
        held += row[1]
        if held > SENT:
            return least
        least = row[0]
    return 1


def vocabulary_of(counts: DataFrame, least: int, total: int) -> Vocabulary:
    listed = counts.where(F.col("every") >= least).select("name", "twin", "c").toArrow()  # SENT rows at most
    name, twin, c = (listed[k].to_numpy() for k in ("name", "twin", "c"))
    name, twin = name.view(np.uint64), twin.view(np.uint64)
    order = np.lexsort((twin, name, -c))
    leaf = F.shiftrightunsigned("twin", 40) % (LEAVES - FIRST_LEAF) + FIRST_LEAF
    summed = counts.where((F.col("every") < least) & (F.col("c") > 0)).groupBy(leaf.alias("leaf")).agg(F.sum(F.col("c") + 1).alias("mass")).toArrow()  # LEAVES rows at most
    leaves = np.zeros(LEAVES, np.int64)
    leaves[summed["leaf"].to_numpy()] = summed["mass"].to_numpy()
    return Vocabulary(name[order], twin[order], c[order], leaves, total)


def _summed(changes: DataFrame) -> DataFrame:
    """(salt, block, change, tasks): the changes of each block, and by how many tasks each weight was changed, summed; rows are streamed, never gathered."""
    schema = changes.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, change, tasks in zip(*(batch.column(c).to_pylist() for c in ("block", "change", "tasks")), strict=True):
                x = np.frombuffer(change, np.float32)
                n = (x != 0).astype(np.int32) if tasks is None else np.frombuffer(tasks, np.int32)
                held = totals.setdefault(block, [np.zeros(len(x)), np.zeros(len(x), np.int32)])
                held[0] += x
                held[1] += n
        if totals:
            columns = [[0] * len(totals), list(totals), [x.astype(np.float32).tobytes() for x, _ in totals.values()], [n.tobytes() for _, n in totals.values()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    return changes.mapInArrow(add, schema)


def train_round(texts: DataFrame, vocabulary, model: Model) -> Model:
    """The model after one round over the rows (text)."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("salt", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("change", T.BinaryType()), T.StructField("tasks", T.BinaryType())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(sent.value)
        for batch in batches:
            steps.learn(batch.column(0), vocabulary.value)
        if steps.seen:
            change = steps.model.flat() - sent.value.flat()
            blocks = range(0, len(change), BLOCK)
            salt = TaskContext.get().partitionId() % 16
            columns = [[salt] * len(blocks), range(len(blocks)), [change[i : i + BLOCK].tobytes() for i in blocks], [None] * len(blocks)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    partly = _summed(texts.select("text").mapInArrow(learn, schema).repartition("block", "salt"))
    total = materialize(_summed(partly.repartition("block")), "weights", BATCH_ROWS)
    flat = model.flat().copy()
    for row in total.collect():  # one model: the number of its blocks is fixed
        at = row.block * BLOCK
        change, tasks = np.frombuffer(row.change, np.float32), np.frombuffer(row.tasks, np.int32)
        flat[at : at + len(change)] += change / np.maximum(tasks, 1)
    return model.moved(flat)


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    rows = rows.withColumn("training", ~F.col("held_out") & F.col("doc_id").isNotNull())
    counts = materialize(count_tokens(rows), "counts", BATCH_ROWS)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(whole.n), int(whole.v)
    least = sent_from(counts)
    context = docs.sparkSession.sparkContext
    words = vocabulary_of(counts, least, n + v + 1)
    vocabulary = context.broadcast(words)
    model = Model.start(words)
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS))
    for turn in range(ROUNDS if n else 0):
        model = train_round(rows.where(F.col("training") & (part == turn)), vocabulary, model)
    trained = context.broadcast(model)
    lists = [T.StructField(k, T.ArrayType(t)) for k, t in (("keys", T.LongType()), ("names", T.LongType()), ("twins", T.LongType()), ("gains", T.DoubleType()))]
    own = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), *_longs("n_tokens", "known")]
    schema = T.StructType([*_longs("key"), *own, T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), *lists])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = batch.num_rows
            sums = np.zeros((4, size))
            for t in read(batch.column(2)):
                columns, rest = scores_of(t, vocabulary.value, trained.value)
                for held, x in zip(sums, columns, strict=True):
                    held += np.bincount(t.row, weights=x, minlength=size)
                if len(rest[0]):
                    found = [pa.array([x], pa.list_(k)) for x, k in zip([key + rest[0], *rest[1:]], (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.record_batch([*(pa.nulls(1, c.type) for c in empty(batch)), *found], names=schema.names)
            if size:
                none = [pa.nulls(size, pa.list_(k)) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
                counted = [pa.array(x.astype(np.int64)) for x in sums[:2]]
                yield pa.record_batch([pa.array(key + np.arange(size)), batch.column(0), batch.column(1), *counted, *map(pa.array, sums[2:]), *none], names=schema.names)
            key += size

    def empty(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([], pa.int64()), batch.column(0), batch.column(1), *(pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]

    scored = materialize(rows.select("doc_id", "held_out", "text").mapInArrow(score, schema), "scores", BATCH_ROWS)
    rare = counts.where((F.col("every") < least) & (F.col("c") > 0)).select("name", "twin", F.log10(F.col("c") + F.lit(1.0)).alias("log"))
    one = F.explode(F.arrays_zip("keys", "names", "twins", "gains")).alias("one")
    met = (
        scored.where(F.col("key").isNull())
        .select(one)
        .select(F.col("one.keys").alias("key"), F.col("one.names").alias("name"), F.col("one.twins").alias("twin"), F.col("one.gains").alias("gain"))
        .join(rare, ["name", "twin"])
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("more_known"), F.sum("log").alias("more"), F.sum(F.col("log") + F.col("gain")).alias("gained"))
    )
    more, gained = F.coalesce("more", F.lit(0.0)), F.coalesce("gained", F.lit(0.0))
    return scored.where(F.col("key").isNotNull()).drop("keys", "names", "twins", "gains").join(met, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + gained).alias("score"),
    )


def scores_of(t: Tokens, vocabulary: Vocabulary, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of every token 1, whether it is known, and log10 of its base and model probabilities; tokens not sent count as unknown.

    Then the rows and hashes of the tokens not sent, and what each gains if it is known, without the log10 of its count + 1.
    """
    places = vocabulary.places(t)
    sent = places.rank >= 0
    counts = np.where(sent, np.take(vocabulary.counts, places.rank, mode="wrap"), 0) if len(vocabulary.counts) else np.zeros(len(sent), np.int64)
    base = np.log10(counts + 1.0) - math.log10(vocabulary.total)
    p = model.log_probabilities(places, t.before, t.skip) / math.log(10)
    at = np.flatnonzero(~sent)
    none = Places(places.rank[at], np.full(len(at), UNKNOWN, np.int32), np.zeros(len(at), np.int32))
    unknown = model.log_probabilities(none, t.before[at], t.skip[at]) / math.log(10)
    gain = p[at] - np.log10(np.maximum(vocabulary.leaves[places.inner[at]], 1)) - unknown
    p[at] = unknown
    return [np.ones(len(sent)), (counts > 0).astype(float), base, p], [t.row[at], t.name[at].view(np.int64), t.twin[at].view(np.int64), gain]
