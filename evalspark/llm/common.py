"""Helpers shared by the operators: Arrow batches as byte strings, hashed words, blobs of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

# Rows per Arrow batch: with texts of a megabyte a batch still fits a Python worker.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows per Arrow batch, since texts may be long. A lower setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
                rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over bounded batches; a worker gives back the memory of a task that is done."""
    small_batches(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound in words and in bytes."""

    LIMIT = 200_000
    LONGEST = 64  # bytes of a word that is remembered; text without blanks is one long word after the other

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return), A-Z in lower case."""
    return text.lower().split()


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
