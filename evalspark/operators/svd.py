"""Truncated SVD of sparse rows in four scans, whatever their number.

Three scans multiply by A' A, first a random block and then what is new each time; the blocks together span a Krylov space, which
holds the leading directions far better than the last block alone. Each task adds up the products of its rows, and
the sums of all tasks are added block by block where they meet. The fourth scan measures the rows inside that space, which takes only a
small square of sums, and turns it to its principal directions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.sums import added

# The functions run inside tasks travel with them, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 100  # a fixed value: dimensions kept
OVERSAMPLE = 20  # columns of a block beyond the dimensions
BLOCKS = 3  # blocks of the Krylov space, one scan each

MAX_SIZE = 1 << 17  # columns: about 115 MB of floats on the driver and in a task
BLOCK = 512  # columns of the matrix summed as one unit
CHUNK = 1024  # rows whose products are held at once inside a task


def _rows(indices: pa.ListArray, values: pa.ListArray, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of every row, each column once."""
    idx, val = (x.flatten().to_numpy(zero_copy_only=False) for x in (indices, values))
    val, end = val.astype(dtype, copy=False), 0
    for length in indices.value_lengths().fill_null(0).to_numpy().tolist():
        start, end = end, end + length
        columns, numbers = idx[start:end], val[start:end]
        if (columns[1:] <= columns[:-1]).any():  # not as ``to_vectors`` writes them
            columns, place = np.unique(columns, return_inverse=True)
            numbers = np.bincount(place, numbers, len(columns)).astype(dtype)
        yield columns, numbers


def _product_parts(indices: pa.ListArray, values: pa.ListArray, basis: np.ndarray) -> Iterator[np.ndarray]:
    """The products of the rows with the basis, ``CHUNK`` rows at a time."""
    found = _rows(indices, values, basis.dtype)
    for start in range(0, len(indices), CHUNK):
        out = np.empty((min(CHUNK, len(indices) - start), basis.shape[1]), basis.dtype)
        for product, (columns, numbers) in zip(out, found):
            np.dot(numbers, basis.take(columns, axis=0), out=product)
        yield out


def _spread(entries: DataFrame, size: int, width: int) -> DataFrame:
    """``entries`` in as many partitions as there are cores, or as many as make their partial sums weigh about as much as the entries.

    A task returns up to size x width numbers, whatever it has read, so beyond that more tasks would only make more to move.
    """
    numbers = entries.agg(F.sum(F.size("indices"))).first()[0] or 0
    wanted = max(entries.sparkSession.sparkContext.defaultParallelism, 2 * numbers // (size * width))
    return entries.repartition(int(wanted)) if entries.rdd.getNumPartitions() < wanted else entries.coalesce(int(wanted))


def _gram_times(entries: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(A' A) basis, in one scan."""
    shared = entries.sparkSession.sparkContext.broadcast(basis.astype(np.float32))

    def task(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray) -> None:
        for columns, numbers in _rows(batch.column(0), batch.column(1), np.float32):
            total[columns] += numbers[:, None] * (numbers @ shared.value.take(columns, axis=0))
            touched[columns] = True

    out = added(entries.select("indices", "values"), task, *basis.shape, BLOCK, np.float32)
    shared.unpersist()
    return out.astype(float)


def _inner_gram(entries: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(A basis)' (A basis), in one scan; a small square, added up row by row."""
    shared = entries.sparkSession.sparkContext.broadcast(basis)
    width = basis.shape[1]

    def task(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray) -> None:
        for product in _product_parts(batch.column(0), batch.column(1), shared.value):
            total += product.T @ product
            touched[:] = True

    out = added(entries.select("indices", "values"), task, width, width, 1, float)
    shared.unpersist()
    return out


def right_vectors(entries: DataFrame, size: int, dimensions: int = DIMENSIONS, seed: int = 42) -> np.ndarray:
    """The leading right singular vectors (size x dimensions) of the rows.

    The driver holds size x 3 x (dimensions + 20) numbers, the broadcast of a scan a third of that; ``size`` is checked.
    """
    if size > MAX_SIZE:
        raise ValueError(f"{size} columns; hash them into at most {MAX_SIZE} first")
    width = min(dimensions + OVERSAMPLE, size)
    entries = _spread(entries, size, width)
    fresh, basis = np.random.default_rng(seed).standard_normal((size, width)), np.zeros((size, 0))
    for _ in range(BLOCKS):
        if basis.shape[1] >= size:
            break
        fresh = _gram_times(entries, fresh)
        for _ in range(2):  # twice, since once leaves rounding behind
            fresh -= basis @ (basis.T @ fresh)
        fresh = np.linalg.qr(fresh[:, : size - basis.shape[1]])[0]
        basis = np.hstack([basis, fresh])
    _, rotate = np.linalg.eigh(_inner_gram(entries, basis))
    vectors = basis @ rotate[:, ::-1][:, : min(dimensions, size)]
    # A fixed sign per direction makes the result repeatable.
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def project(entries: DataFrame, vectors: np.ndarray) -> DataFrame:
    """row_id, features: array<double>, each row times the right vectors."""
    shared = entries.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for dense in _product_parts(batch.column(1), batch.column(2), shared.value):
                ends = pa.array(np.arange(len(dense) + 1) * dense.shape[1], pa.int32())
                features = pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(dense)), features], ["row_id", "features"])
                start += len(dense)

    id_type = entries.schema["row_id"].dataType.simpleString()
    return entries.select("row_id", "indices", "values").mapInArrow(rows, f"row_id {id_type}, features array<double>")


def svd_features(entries: DataFrame, size: int, dimensions: int = DIMENSIONS) -> DataFrame:
    return project(entries, right_vectors(entries, size, dimensions))
