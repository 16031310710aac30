"""Sums of matrices that tasks make of their rows, added block by block where the blocks meet."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The functions run inside tasks travel with them, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = pa.schema([("block", pa.int64()), ("terms", pa.binary()), ("part", pa.binary())])


def sum_runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a sorted key list, and the sum of the rows of each."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(rows, starts, axis=0)


def added(df: DataFrame, task: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], None], rows: int, width: int, block: int,
          dtype: type = float) -> np.ndarray:
    """The sum of the matrices (rows x width) of all partitions.

    ``task`` adds a batch to the matrix of its partition and marks the rows it has touched. A partition returns its touched
    rows in blocks; the blocks of all partitions are added in as many groups. The driver gets rows x width numbers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((rows, width), dtype), np.zeros(rows, bool)
        for batch in batches:
            task(batch, total, touched)
        for start in range(0, rows, block):
            terms = np.flatnonzero(touched[start : start + block]) + start
            if len(terms):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start]), pa.array([terms.tobytes()], pa.binary()), pa.array([total[terms].tobytes()], pa.binary())], schema=SUMS)

    def meet(table: pa.Table) -> pa.Table:
        start = table.column("block")[0].as_py()
        total, touched = np.zeros((block, width), dtype), np.zeros(block, bool)
        for terms, part in zip(table.column("terms"), table.column("part")):
            at = np.frombuffer(terms.as_buffer(), np.int64) - start
            total[at] += np.frombuffer(part.as_buffer(), dtype).reshape(-1, width)
            touched[at] = True
        at = np.flatnonzero(touched)
        return pa.table([[start], [(at + start).tobytes()], [total[at].tobytes()]], schema=SUMS)

    layout = "block long, terms binary, part binary"
    sums = df.mapInArrow(partial, layout).groupBy("block").applyInArrow(meet, layout)
    out = np.zeros((rows, width), dtype)
    found = sums.toArrow()
    for terms, part in zip(found["terms"], found["part"]):
        out[np.frombuffer(terms.as_buffer(), np.int64)] = np.frombuffer(part.as_buffer(), dtype).reshape(-1, width)
    return out
