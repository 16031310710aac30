"""Clustering training rows, and choosing one example from every (label, cluster) cell."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.scalars import share
from evalspark.functions.vectors import l2_normalise, squared_distance
from evalspark.operators import kmeans
from evalspark.operators.sampling import SEED, local_table
from evalspark.operators.svd import svd_features
from evalspark.operators.tabular import fit_imputer, fit_one_hot, fit_standardiser, vector_width
from evalspark.operators.tfidf import fit_tfidf, placed_terms, to_vectors, with_counts
from evalspark.plans.task import Task
from evalspark.session import stage

# Fixed values of the cluster selection.
MAX_K = 8
MIN_CELL_SIZE = 3
RESTARTS = 4
TEXT_MIN_DF = 2
TEXT_WIDTH = 1 << 16  # positions that terms are hashed into


def text_features(train: DataFrame, text: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """TF-IDF weights reduced by SVD. At length 1, long and short texts on one topic lie together."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    train = with_counts(train, text, stop_words=stop_words)
    model = fit_tfidf(train, text, min_df=TEXT_MIN_DF, stop_words=stop_words)
    numbered, size = placed_terms(model.vocabulary, TEXT_WIDTH)
    entries = to_vectors(model, numbered, size, train).entries()
    return svd_features(entries, size).withColumn("features", l2_normalise(F.col("features")))


def table_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Imputed and standardised numbers, then one column per frequent category and one for the rest."""
    rows = fit_imputer(train, numeric, categorical).transform(train.select("row_id", *numeric, *categorical))
    parts = []
    if numeric:
        scaler = fit_standardiser(rows, numeric)
        parts.append(F.array(*[scaler.column(c) for c in numeric]))
    plain = rows
    for c in categorical:
        positions = fit_one_hot(plain, c).positions()
        rows = positions.placed(rows, f"_place_{c}")
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(positions.size - 1)), _is_at(f"_place_{c}")))
    return rows.select("row_id", F.concat(*parts).alias("features"))


def _is_at(place: str) -> Callable[[Column], Column]:
    return lambda i: F.when(i == F.col(place), 1.0).otherwise(0.0)


def vector_features(train: DataFrame, vector: str) -> DataFrame:
    """Every dimension standardised."""
    size = vector_width(train, vector)
    columns = [f"d{i}" for i in range(size)]
    wide = train.select("row_id", *[F.col(vector)[i].cast("double").alias(c) for i, c in enumerate(columns)])
    scaler = fit_standardiser(wide, columns)
    return wide.select("row_id", F.array(*[scaler.column(c) for c in columns]).alias("features"))


def cluster_features(task: Task, train: DataFrame) -> DataFrame:
    """row_id, features: array<double>, from the same inputs as the trained model."""
    rows = task.prepare(train)
    if task.text is not None:
        return text_features(rows, task.text)
    if task.vector is not None:
        return vector_features(rows, task.vector)
    return table_features(rows, task.numeric, task.categorical)


def kmeans_best(features: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> kmeans.Clustering:
    """The k-means of lowest cost among a few starts. ``features``: row_id, features (an array of numbers)."""
    return kmeans.fit(features, [k], restarts, seed)[k]


def choose_k(
    features: DataFrame, min_k: int, max_k: int = MAX_K, restarts: int = RESTARTS, seed: int = SEED
) -> tuple[kmeans.Clustering, dict[int, float]]:
    """The best clustering by silhouette among k from max(2, min_k) to max(max_k, min_k), and all silhouettes.

    All k and all starts are fitted in the same scans. The silhouette is on squared Euclidean distance: linear in the rows, so all of
    them count. The smallest k wins a tie.
    """
    found = kmeans.fit(features, range(max(2, min_k), max(max_k, min_k) + 1), restarts, seed)
    scores = dict(zip(found, kmeans.silhouettes(features, list(found.values()))))
    return found[max(scores, key=lambda k: (scores[k], -k))], scores


def assign_nearest(rows: DataFrame, centres: Sequence[Sequence[float]], features: str = "features") -> DataFrame:
    """Add ``cluster``: the nearest of the given centres by Euclidean distance, the first on ties."""
    distances = F.array(
        *[
            F.struct(squared_distance(F.col(features), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("c"))
            for i, c in enumerate(centres)
        ]
    )
    return rows.withColumn("cluster", F.array_min(distances)["c"])


def cluster_cells(rows: DataFrame) -> DataFrame:
    """label, cluster, cell_size, cluster_size and the label's share of the cluster."""
    cells = rows.groupBy("label", "cluster").agg(F.count("*").alias("cell_size"))
    size = F.sum("cell_size").over(Window.partitionBy("cluster"))
    return cells.withColumn("cluster_size", size).withColumn(
        "label_share", share(F.col("cell_size"), F.col("cluster_size"))
    )


def cell_representatives(rows: DataFrame, min_size: int = MIN_CELL_SIZE) -> DataFrame:
    """Per cell of at least ``min_size`` rows: the row nearest the mean of the whole cell.

    Only short rows are candidates where the cell has any. ``rows``: row_id, label, cluster, short,
    features. Everything is aggregated per cell, so a cell of any size passes through many tasks.
    """
    centres = rows.groupBy("label", "cluster").agg(Summarizer.mean(array_to_vector("features")).alias("_centre"))
    # Staged, so that Spark knows how large the centres really are before it broadcasts them.
    centres = stage(centres.withColumn("_centre", vector_to_array("_centre")), "centres")
    measured = rows.join(centres, ["label", "cluster"])
    candidate = F.struct(
        (~F.col("short")).alias("long"), squared_distance(F.col("features"), F.col("_centre")).alias("distance"),
        F.col("row_id"),
    )
    nearest = measured.groupBy("label", "cluster").agg(F.min(candidate).alias("_nearest"))
    return cluster_cells(rows).where(F.col("cell_size") >= min_size).join(nearest, ["label", "cluster"]).select(
        "label", "cluster", "cell_size", "cluster_size", "label_share", F.col("_nearest.row_id").alias("row_id"),
        F.sqrt("_nearest.distance").alias("distance"),
    )


@dataclass(frozen=True)
class ClusterSelection:
    cells: DataFrame  # staged: label, cluster, sizes, label_share, row_id, place
    k: int
    silhouettes: dict[int, float]

    def shots(self, train: DataFrame) -> DataFrame:
        """The chosen training rows with ``place``, their order by label and cluster."""
        return train.join(self.cells.select("row_id", "place"), "row_id")


def select_cluster_shots(task: Task, train: DataFrame, short: Column | None = None) -> ClusterSelection:
    """One training row per (label, cluster) cell, with the clustering it came from."""
    features = stage(cluster_features(task, train), "cluster-features")
    model, scores = choose_k(features, min_k=len(task.labels))
    grouped = assign_nearest(features, model.centres.tolist())
    flags = train.select("row_id", F.col("label").cast("string").alias("label"),
                         (task.is_short() if short is None else short).alias("short"))
    rows = stage(flags.join(grouped, "row_id"), "clustered-rows")
    order = [{"label": l, "place_of_label": i} for i, l in enumerate(task.labels)]
    labels = local_table(train.sparkSession, order, pa.schema([("label", pa.string()), ("place_of_label", pa.int64())]))
    cells = cell_representatives(rows).join(F.broadcast(labels), "label")
    placed = cells.withColumn("place", F.col("place_of_label") * model.k + F.col("cluster")).drop("place_of_label")
    return ClusterSelection(stage(placed, "cells"), model.k, scores)
