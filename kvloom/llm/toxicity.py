"""Toxicity by a classifier chain of linear models over word presence.

The categories are predicted one after another.  The model of a category sees
the words of the text and the probabilities of all earlier categories; in
training these are out-of-fold predictions of ``FOLDS`` folds, so a later model
never sees what an earlier one has learned by heart.

Features are 64-bit hashes of lower-cased words and of their first four and six
characters (inflected and compound words share these); all those are kept that
a chi-square test over the training texts ties to a category (at least
``LEAST_CHI2``).

Training is on a bounded sample of about ``MOST_TEXTS`` labelled texts, chosen
by a hash of the id; the models of the folds and of the whole sample are fitted
in tasks.  Scoring reads every whole text.

Cases: null and empty texts have no words and get the prior; labels that
repeat an id count as positive if one of them is; of documents that repeat a
labelled id one is trained on; null labels count as negative; labels without a
document are ignored; without labels every probability is 0 and nothing is
rejected; rows that repeat are judged separately; texts of any length are
scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import materialize, ship_package
from kvloom.llm.shingles import words as words_of

#: Label columns in the order of the chain, each with the value that means the category.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
THRESHOLD = 0.3
STEMS = (4, 6)
FOLDS = 5
MOST_TEXTS = 10_000
LEAST_CHI2 = 15.0
LEAST_TEXTS = 3
RIDGE = 0.1
STEPS = 150
SETTLED = 1e-4


def word_features(text: Column) -> Column:
    """Distinct 64-bit features of a text."""
    words = words_of(text)
    return F.array_distinct(F.flatten(F.array(F.transform(words, lambda w: F.xxhash64(w)), *[_stems(words, n) for n in STEMS])))


def _stems(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.xxhash64(F.substring(w, 1, n), F.lit(n)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """Logistic model: word weights, weights of earlier categories, intercept."""

    words: np.ndarray
    chain: np.ndarray
    bias: float

    def probability(self, row: np.ndarray, feature: np.ndarray, rows: int, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(row, weights=self.words[feature], minlength=rows) + earlier @ self.chain + self.bias)


def fit(row: np.ndarray, feature: np.ndarray, features: int, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by accelerated gradient steps, until the gradient has shrunk to ``SETTLED`` of its first size; the intercept is free."""
    rows = len(y)
    rate = np.clip(y.mean() if rows else 0.0, 1e-6, 1 - 1e-6)
    x, bias = np.zeros(features + earlier.shape[1]), float(np.log(rate / (1 - rate)))
    ahead, ahead_bias, turn, least = x.copy(), bias, 1.0, None
    widest = np.bincount(row, minlength=rows).max(initial=0) + earlier.shape[1] + 1
    step = 4.0 / (rows * max(1.0, widest) ** 0.5 / 4 + RIDGE)
    for _ in range(STEPS):
        z = _margins(row, feature, features, earlier, ahead, ahead_bias, rows)
        error, loss = sigmoid(z) - y, _loss(z, y, ahead)
        slope = np.r_[np.bincount(feature, weights=error[row], minlength=features), earlier.T @ error] + RIDGE * ahead
        square = slope @ slope + error.sum() ** 2
        least = square * SETTLED**2 if least is None else least
        if square <= least:
            break
        while True:  # backtracking
            new, new_bias = ahead - step * slope, ahead_bias - step * error.sum()
            if step < 1e-12 or _loss(_margins(row, feature, features, earlier, new, new_bias, rows), y, new) <= loss - step / 2 * square + 1e-12:
                break
            step /= 2
        following = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        push = (turn - 1) / following
        ahead, ahead_bias = new + push * (new - x), new_bias + push * (new_bias - bias)
        x, bias, turn = new, new_bias, following
    return Linear(x[:features], x[features:], bias)


def _margins(row, feature, features, earlier, x, bias, rows) -> np.ndarray:
    return np.bincount(row, weights=x[:features][feature], minlength=rows) + earlier @ x[features:] + bias


def _loss(z, y, x) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + RIDGE / 2 * (x @ x))


@dataclass
class Sample:
    """Training texts: the cells (row, feature), labels and folds."""

    row: np.ndarray
    feature: np.ndarray
    features: int
    labels: np.ndarray
    fold: np.ndarray

    def fit_without(self, k: int, fold: int, earlier: np.ndarray) -> Linear:
        """The model of category k over all texts outside of ``fold``."""
        train = np.flatnonzero(self.fold != fold)
        place = np.full(len(self.labels), -1)
        place[train] = np.arange(len(train))
        inside = place[self.row] >= 0
        return fit(place[self.row[inside]], self.feature[inside], self.features, earlier[train], self.labels[train, k].astype(float))


def fit_chain(sample: Sample, fit_folds) -> list[Linear]:
    """One model a category; each gets out-of-fold probabilities of those before it.

    ``fit_folds(k, earlier)`` gives the models of category k without each fold,
    and without none.
    """
    rows, chain, earlier = len(sample.labels), [], np.zeros((len(sample.labels), 0))
    for k in range(sample.labels.shape[1]):
        *partial, whole = fit_folds(k, earlier)
        chain.append(whole)
        out = np.zeros(rows)
        for f, model in enumerate(partial):
            test = sample.fold == f
            out[test] = model.probability(sample.row, sample.feature, rows, earlier)[test]
        earlier = np.c_[earlier, out]
    return chain


def _in_tasks(spark: SparkSession, sample: Sample):
    """``fit_folds`` of fit_chain(), each fold in a task of its own."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(sample)
    schema = T.StructType([T.StructField("fold", T.LongType()), T.StructField("weights", T.BinaryType())])

    def fit_folds(k: int, earlier: np.ndarray) -> list[Linear]:
        given = spark.sparkContext.broadcast(earlier)

        def run(batches):
            for batch in batches:
                for fold in batch.column(0).to_pylist():
                    model = sent.value.fit_without(k, fold, given.value)
                    flat = np.r_[model.words, model.chain, model.bias]
                    yield pa.record_batch([pa.array([fold]), pa.array([flat.tobytes()], pa.binary())], names=["fold", "weights"])

        found = dict(spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, schema).collect())  # FOLDS + 1 models
        flat = [np.frombuffer(found[f], float) for f in range(FOLDS + 1)]
        return [Linear(x[: sample.features], x[sample.features : -1], float(x[-1])) for x in flat]

    return fit_folds


@dataclass
class Chain:
    """Sorted word hashes and the models over them."""

    vocabulary: np.ndarray
    models: list[Linear]

    def predict(self, row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
        """(rows, categories) probabilities for the distinct word hashes of each row."""
        if not len(self.models):
            return np.zeros((rows, 0))
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashes
            row, feature = row[known], at[known]
        else:
            row, feature = row[:0], np.zeros(0, np.int64)
        earlier = np.zeros((rows, 0))
        for model in self.models:
            earlier = np.c_[earlier, model.probability(row, feature, rows, earlier)]
        return earlier


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, text: str = "text", doc_id: str = "doc_id", label_id: str = "doc_id", most_texts: int = MOST_TEXTS) -> Chain:
    flags = [F.max(F.when(F.col(column) == value, 1).otherwise(0)).alias(f"y{k}") for k, (_, column, value) in enumerate(categories)]
    listed = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(*flags)
    share = min(1.0, most_texts / max(1, listed.count()))
    place = F.pmod(F.xxhash64("label_id", F.lit("sample")), F.lit(1_000_000))
    sample = listed.where(place < share * 1_000_000).withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # about most_texts labels, so the broadcast is bounded; documents stay where they are
    met = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(sample), "label_id")
    one = met.groupBy("label_id", "fold", *[f"y{k}" for k in range(len(categories))]).agg(F.min("text").alias("text"))  # a labelled id may repeat
    texts = materialize(one.withColumn("at", F.monotonically_increasing_id()).withColumn("words", word_features(F.col("text"))).drop("text"), "labelled")
    names = [f"y{k}" for k in range(len(categories))]
    base = texts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in names]).first()
    if not base.n:
        return Chain(np.zeros(0, np.int64), [])
    n, words = float(base.n), texts.select("at", *names, F.explode("words").alias("word"))
    df = F.col("df").cast("double")
    tests = []
    for y in names:
        positive, hit = float(base[y]), F.col(y).cast("double")
        gap = F.abs(hit * n - df * positive)
        tests.append(F.coalesce(n * F.pow(gap - n / 2, 2) / F.nullif(df * (n - df) * F.lit(positive * (n - positive)), F.lit(0.0)) * (gap > n / 2).cast("double"), F.lit(0.0)))
    chi2 = F.greatest(*tests, F.lit(0.0))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), *[F.sum(y).alias(y) for y in names]).where(F.col("df") >= LEAST_TEXTS)
    kept = counted.where(chi2 >= LEAST_CHI2).select("word").toArrow()  # words of about most_texts texts
    vocabulary = np.sort(kept["word"].to_numpy())
    rows = texts.select("at", "fold", *names).orderBy("at").toArrow()  # about most_texts rows
    listed_words = docs.sparkSession.createDataFrame([(int(w),) for w in vocabulary], "word long")
    cells = words.select("at", "word").join(F.broadcast(listed_words), "word").toArrow()  # words of about most_texts texts
    at, fold = rows["at"].to_numpy(), rows["fold"].to_numpy()
    row = np.searchsorted(at, cells["at"].to_numpy())
    feature = np.searchsorted(vocabulary, cells["word"].to_numpy())
    labels_ = np.stack([rows[y].to_numpy() for y in names], axis=1)
    sample_ = Sample(row, feature, len(vocabulary), labels_, fold)
    return Chain(vocabulary, fit_chain(sample_, _in_tasks(docs.sparkSession, sample_)))


def _probabilities(docs: DataFrame, chain: Chain, categories, text: str) -> Column:
    """An array of the probabilities of all categories.

    Features outside the vocabulary are dropped in the JVM, so that only short
    arrays go to Python and the other columns never do.
    """
    sent, count = docs.sparkSession.sparkContext.broadcast(chain), len(categories)
    ship_package(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def score(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        p = sent.value.predict(row, lists.flatten().to_numpy(zero_copy_only=False), len(lists))
        if not p.shape[1]:
            p = np.zeros((len(lists), count))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * count, pa.int32()), pa.array(np.ascontiguousarray(p).ravel()))

    if not len(chain.vocabulary):
        return score(F.when(F.lit(False), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    return score(F.filter(word_features(F.col(text)), lambda f: f.isin(chain.vocabulary.tolist())))


def judge(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, p_<category> of every category, rejected (by the last category)."""
    chain = train(docs, labels, categories, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = rows.select("doc_id", _probabilities(rows, chain, categories, "text").alias("p"))
    return scored.select("doc_id", *[F.col("p")[k].alias(f"p_{name}") for k, (name, _, _) in enumerate(categories)], (F.col("p")[len(categories) - 1] >= threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    chain = train(docs, labels, categories, text, doc_id)
    scored = docs.withColumn("__kv_p", _probabilities(docs, chain, categories, text))
    return scored.where(F.col("__kv_p")[len(categories) - 1] < threshold).select(*[F.col(c) for c in docs.columns])
