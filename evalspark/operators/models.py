"""Baseline models. Each is fitted on training rows and scores rows per label.

``prepare(task, rows)`` does once what all fits on parts of the rows would repeat.
``fit(task, train)`` returns a model whose ``score(df)`` gives row_id, pred and ``raw``: an array
with one value per label, probabilities or (when ``probabilistic`` is false) decision values.
"""

from __future__ import annotations

import functools
import time
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scalars import argmax_label, null_if_nan
from evalspark.operators import boosting, linear, tfidf
from evalspark.operators.metrics import metrics
from evalspark.operators.sampling import FOLDS, stratified_folds
from evalspark.operators.svd import project
from evalspark.operators.tabular import Standardiser, fit_standardiser, ordinal_codes, vector_width, with_ordinal_code
from evalspark.plans.task import Task
from evalspark.session import stage


# Terms are hashed into this many positions, so that no term is dropped and a model stays bounded.
WIDTH = 1 << 18
# Limits of the optimisers, far beyond what they need as a rule.
NUMERIC_ITERATIONS, STAGE2_ITERATIONS = 1000, 1000


class Scoring(Protocol):
    probabilistic: bool

    def score(self, df: DataFrame) -> DataFrame: ...


class Baseline(Protocol):
    def prepare(self, task: Task, rows: DataFrame) -> DataFrame: ...

    def fit(self, task: Task, train: DataFrame) -> Scoring: ...


def label_index(task: Task) -> Column:
    """The position of the label in the task's label list, as Spark ML wants it."""
    labels = F.array(*[F.lit(l) for l in task.labels])
    return (F.array_position(labels, F.col("label").cast("string")) - 1).cast("double")


def _scored(task: Task, predictions: DataFrame, column: str) -> DataFrame:
    raw = predictions.select("row_id", vector_to_array(column).alias("raw"))
    return raw.select("row_id", argmax_label([F.col("raw")[i] for i in range(len(task.labels))], task.labels).alias("pred"), "raw")


class Prepared:
    """A baseline whose fits share nothing worth keeping."""

    def prepare(self, task: Task, rows: DataFrame) -> DataFrame:
        return rows


# ---------------------------------------------------------------- text


class TextBaseline:
    """A baseline on term counts; the texts are split once for all fits."""

    bigrams = False

    def prepare(self, task: Task, rows: DataFrame) -> DataFrame:
        return tfidf.with_counts(rows, task.text, self.bigrams, keep=[c for c in rows.columns if c not in ("row_id", task.text)])


@dataclass(frozen=True)
class NaiveBayes(TextBaseline):
    """Multinomial naive Bayes on TF-IDF, fully relational."""

    alpha: float = tfidf.ALPHA

    def fit(self, task: Task, train: DataFrame) -> Scoring:
        rows = train.withColumn("label", F.col("label").cast("string"))
        return _NaiveBayesScoring(tfidf.fit_naive_bayes(rows, task.labels, task.text, alpha=self.alpha))

    def out_of_fold(self, task: Task, folded: DataFrame, folds: int) -> tuple[DataFrame, bool]:
        """All folds from the same counts, the fold's own taken off."""
        rows = self.prepare(task, folded).withColumn("label", F.col("label").cast("string"))
        return tfidf.out_of_fold(rows, task.labels, folds, task.text, alpha=self.alpha), True


@dataclass(frozen=True)
class _NaiveBayesScoring:
    model: tfidf.NaiveBayesModel
    probabilistic: bool = True

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df).withColumnRenamed("probabilities", "raw")


@dataclass(frozen=True)
class TextVectors:
    """TF-IDF vectors for Spark ML, fitted on training rows."""

    model: tfidf.TfidfModel
    numbered: DataFrame
    size: int

    @staticmethod
    def fit(train: DataFrame, text: str, width: int, **options) -> TextVectors:
        model = tfidf.fit_tfidf(train, text, **options)
        return TextVectors(model, *tfidf.placed_terms(model.vocabulary, width))

    def entries(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return tfidf.to_vectors(self.model, self.numbered, self.size, df, keep).entries(keep)


@dataclass(frozen=True)
class _TextScoring:
    task: Task
    vectors: TextVectors
    coefficients: np.ndarray  # terms and, last, intercepts x classes
    probabilistic: bool

    def score(self, df: DataFrame) -> DataFrame:
        margins = project(self.vectors.entries(df), self.coefficients[:-1])
        z = [F.col("features")[i] + F.lit(float(x)) for i, x in enumerate(self.coefficients[-1])]
        if not self.probabilistic:
            raw = F.array(*z)
        elif len(z) == 1:
            raw = F.array(1 / (1 + F.exp(z[0])), 1 / (1 + F.exp(-z[0])))
        else:
            odds = F.transform(F.array(*z), lambda x: F.exp(x - F.greatest(*z)))
            raw = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, y: a + y))
        scored = margins.select("row_id", raw.alias("raw"))
        return scored.select("row_id", argmax_label([F.col("raw")[i] for i in range(len(self.task.labels))], self.task.labels).alias("pred"), "raw")


def _fit_linear(task: Task, train: DataFrame, vectors: TextVectors, loss: str, c: float, classes: int, **options) -> np.ndarray:
    entries = vectors.entries(train.select("*", label_index(task).alias("_class")), keep=["_class"])
    return linear.fit(entries.withColumnRenamed("_class", "label"), vectors.size, classes, loss, c, **options)


def _warn_if_cut(model: Model, what: str) -> Model:
    """Say so when an optimiser stopped at its limit of iterations and not at a minimum."""
    parts = getattr(model, "models", [model])
    for part in parts:
        summary = part.summary if part.hasSummary else None
        summary = summary() if callable(summary) else summary  # a method in some models, a property in others
        if summary is not None and summary.totalIterations >= part.getMaxIter():
            warnings.warn(f"{what} stopped at its limit of {part.getMaxIter()} iterations", stacklevel=2)
    return model


@dataclass(frozen=True)
class TextLogistic(TextBaseline):
    """Logistic regression on TF-IDF of words and word pairs. ``c`` weighs the summed loss."""

    c: float = 4.0
    bigrams: bool = True
    min_df: int = 2
    width: int = WIDTH
    tol: float = 1e-4

    def fit(self, task: Task, train: DataFrame) -> Scoring:
        train = self.prepare(task, train)
        vectors = TextVectors.fit(train, task.text, self.width, bigrams=self.bigrams, min_df=self.min_df)
        loss, classes = ("log", 1) if len(task.labels) == 2 else ("softmax", len(task.labels))
        return _TextScoring(task, vectors, _fit_linear(task, train, vectors, loss, self.c, classes, tol=self.tol), True)


@dataclass(frozen=True)
class TextSvm(TextBaseline):
    """Linear support vector machine, one against the rest, on TF-IDF of words: squared hinge loss, whose sum ``c``
    weighs; intercepts count as coefficients of a column of ones."""

    c: float = 1.0
    min_df: int = 2
    width: int = WIDTH
    tol: float = 1e-4

    def fit(self, task: Task, train: DataFrame) -> Scoring:
        train = self.prepare(task, train)
        vectors = TextVectors.fit(train, task.text, self.width, min_df=self.min_df)
        found = _fit_linear(task, train, vectors, "squared_hinge", self.c, len(task.labels), free_intercept=False, tol=self.tol)
        return _TextScoring(task, vectors, found, False)


def logistic(c: float, n: int, max_iter: int = STAGE2_ITERATIONS) -> LogisticRegression:
    """L2 logistic regression whose ``c`` weighs the summed loss; Spark's own weighs the mean."""
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)


# ---------------------------------------------------------------- tables


@dataclass(frozen=True)
class TableBoosting(Prepared):
    """Gradient-boosted trees on numbers and ordinal category codes.

    Missing numbers, and categories that are missing or were not seen in training, are bins of their own, whose side
    every split learns. A category column with more categories than bins shares bins between neighbours in the order of the codes.
    """

    iterations: int = 100
    depth: int = 5
    step: float = 0.1
    min_rows: int = 20

    def fit(self, task: Task, train: DataFrame) -> Scoring:
        rows = stage(task.prepare(train), "boosting-rows") if task.categorical else task.prepare(train)
        codes = {c: stage(ordinal_codes(rows, c), "ordinal-codes") for c in task.categorical}
        frame = self._frame(task, rows, codes).withColumn("label", label_index(task))
        model = boosting.fit(frame, len(codes) + len(task.numeric), len(task.labels), range(len(codes)), self.iterations, self.depth, self.step,
                             min_rows=self.min_rows)
        return _BoostingScoring(task, self, codes, model)

    def _frame(self, task: Task, rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
        for c, table in codes.items():
            rows = with_ordinal_code(rows, table, c, f"_code_{c}")
        parts = [F.when(F.col(f"_code_{c}") >= 0, F.col(f"_code_{c}").cast("double")) for c in task.categorical]
        parts += [null_if_nan(F.col(c).cast("double")) for c in task.numeric]
        return rows.withColumn("features", F.array(*parts))


@dataclass(frozen=True)
class _BoostingScoring:
    task: Task
    baseline: TableBoosting
    codes: dict[str, DataFrame]  # per column, a table of categories and their codes
    model: boosting.Boosted
    probabilistic: bool = True

    def score(self, df: DataFrame) -> DataFrame:
        rows = self.task.prepare(df)
        frame = self.baseline._frame(self.task, stage(rows, "boosting-rows") if self.codes else rows, self.codes)
        scored = self.model.probabilities(frame)
        best = argmax_label([F.col("raw")[i] for i in range(len(self.task.labels))], self.task.labels)
        return scored.select("row_id", best.alias("pred"), "raw")


@dataclass(frozen=True)
class NumericLogistic(Prepared):
    """Logistic regression on standardised numbers: the numeric columns or the vector of a task."""

    c: float = 1.0
    max_iter: int = NUMERIC_ITERATIONS

    def fit(self, task: Task, train: DataFrame) -> Scoring:
        rows = task.prepare(train)
        width = vector_width(rows, task.vector) if task.vector else 0
        wide, columns = _wide(task, rows, width)
        scaler = fit_standardiser(wide, columns)
        frame = _standardised(wide, columns, scaler).withColumn("label", label_index(task)).persist()
        model = _warn_if_cut(logistic(self.c, frame.count(), self.max_iter).fit(frame), "logistic regression")
        frame.unpersist()
        return _NumericScoring(task, width, columns, scaler, model)


def _wide(task: Task, rows: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    if task.vector is None:
        return rows, list(task.numeric)
    names = [f"_d{i}" for i in range(width)]
    return rows.select("*", *[F.col(task.vector)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def _standardised(wide: DataFrame, columns: list[str], scaler: Standardiser) -> DataFrame:
    return wide.withColumn("features", array_to_vector(F.array(*[scaler.column(c) for c in columns])))


@dataclass(frozen=True)
class _NumericScoring:
    task: Task
    width: int
    columns: list[str]
    scaler: Standardiser
    model: Model
    probabilistic: bool = True

    def score(self, df: DataFrame) -> DataFrame:
        wide, columns = _wide(self.task, self.task.prepare(df), self.width)
        return _scored(self.task, self.model.transform(_standardised(wide, columns, self.scaler)), "probability")


# ---------------------------------------------------------------- using them


def with_score(task: Task, scored: DataFrame) -> DataFrame:
    """Add ``score``: the positive label's value for a binary task, else null."""
    value = F.col("raw")[1] if task.is_binary else F.lit(None).cast("double")
    return scored.withColumn("score", value)


def evaluate_baseline(task: Task, split: DataFrame, baseline: Baseline | None = None) -> tuple[DataFrame, float]:
    """Fit on the train split, measure on the scored rows and on the whole test split.

    Returns one row per field ("metrics", "full_test_metrics") and the fit time in seconds.
    """
    baseline = baseline or task.baseline
    start = time.perf_counter()
    model = baseline.fit(task, split.where(F.col("split") == "train"))
    seconds = time.perf_counter() - start
    test = split.where(F.col("split") == "test")
    truth = test.select("row_id", F.col("label").cast("string").alias("label"), "is_scored")
    pred = stage(with_score(task, truth.join(model.score(test), "row_id")).drop("raw"), "baseline-scores")
    fields = F.when(F.col("is_scored"), F.array(F.lit("metrics"), F.lit("full_test_metrics"))).otherwise(
        F.array(F.lit("full_test_metrics"))
    )
    both = pred.withColumn("field", F.explode(fields))
    return metrics(both, task.labels, task.positive, by=["field"]), seconds


def refitted_scores(task: Task, folded: DataFrame, baseline: Baseline, folds: int) -> tuple[DataFrame, bool]:
    """The whole baseline, vocabulary included, is fitted again for every fold."""
    parts = []
    for i in range(folds):
        model = baseline.fit(task, folded.where(F.col("fold") != i))
        scored = model.score(folded.where(F.col("fold") == i))
        parts.append(scored.select("row_id", F.lit(i).alias("fold"), "raw"))
    return functools.reduce(DataFrame.unionByName, parts), model.probabilistic


def oof_scores(task: Task, train: DataFrame, baseline: Baseline | None = None, folds: int = FOLDS) -> tuple[DataFrame, bool]:
    """row_id, fold, raw: every training row scored by a model that did not see it.

    A baseline that can take a fold out of its counts (``out_of_fold``) does so; any other is fitted once per fold.
    Also says whether the scores are probabilities.
    """
    baseline = baseline or task.baseline
    folded = baseline.prepare(task, stratified_folds(train, folds=folds))
    if hasattr(baseline, "out_of_fold"):
        scores, probabilistic = baseline.out_of_fold(task, folded, folds)
    else:
        scores, probabilistic = refitted_scores(task, folded, baseline, folds)
    return stage(scores, "oof-scores"), probabilistic
