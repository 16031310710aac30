"""Linear classifiers on sparse rows, all classes in the same scans, by Newton's method.

The objective is ``|w|^2 / 2 + c * (sum of the losses)`` per class (squared hinge or log loss of each class against the rest) or of all
classes together (softmax). A scan gives the loss and gradient, or the product of the Hessian with a direction, of
all classes at once: a task multiplies its rows with the coefficients, turns margins into residuals, and adds up the
touched coefficients. Directions come from conjugate gradients, whose steps are one scan each, and a step that
does not lower the objective is halved. What adds nothing to a sum is not multiplied: classes that have settled, and in products with the
Hessian of the squared hinge the rows that lie beyond the margin for every class. Rows are packed once, up to ``ENTRIES`` entries to a block of bytes, so a scan reads arrays.

The driver holds a few copies of (columns x classes) numbers, and so does a task.
"""

from __future__ import annotations

import contextlib
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.sums import added
from evalspark.session import stage

# The functions run inside tasks travel with them, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = 1_000_000  # matrix entries of a packed block; a large block meets a column often, and adds it up once
BATCH = 4  # packed blocks that are handed to Python at once
BLOCK = 1 << 15  # coefficients summed as one unit
SHARE = 4  # entries that a task reads, beyond the first ones, for every coefficient that it may return
MAX_NUMBERS = 1 << 25  # columns x classes: 256 MB of doubles
LOSSES = ("squared_hinge", "log", "softmax")


def _pack_task(size: int):
    """Rows as blocks of bytes: labels, row ends, the columns of the block, the place of every entry among them, values.

    The most frequent columns come first, so that what most entries refer to lies together. Every row has a one in column ``size``.
    """

    def packed(labels: list, indices: list, values: list) -> pa.RecordBatch:
        ends = np.cumsum([len(i) + 1 for i in indices], dtype=np.int64)
        columns, found, counts = np.unique(np.concatenate([np.r_[i, size] for i in indices]), return_inverse=True, return_counts=True)
        numbers = np.concatenate([np.r_[v, 1.0] for v in values]).astype(np.float64)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        parts = [np.array(labels, np.int32), ends, columns[order].astype(np.int32), place[found], numbers]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["labels", "ends", "columns", "places", "numbers"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, indices, values, held = [], [], [], 0
        for batch in batches:
            for label, index, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                labels.append(label)
                indices.append(index.values.to_numpy(zero_copy_only=False))
                values.append(value.values.to_numpy(zero_copy_only=False))
                held += len(indices[-1]) + 1
                if held >= ENTRIES:
                    yield packed(labels, indices, values)
                    labels, indices, values, held = [], [], [], 0
        if labels:
            yield packed(labels, indices, values)

    return task


def _margins(ends: np.ndarray, places: np.ndarray, numbers: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Rows times coefficients; a product per row stays in the cache, and no array of (entries x classes) is made."""
    out, start = np.empty((len(ends), coefficients.shape[1])), 0
    for i, end in enumerate(ends.tolist()):
        np.dot(numbers[start:end], coefficients.take(places[start:end], axis=0), out=out[i])
        start = end
    return out


def _rows_of(keep: np.ndarray, ends: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept rows of a block, packed the same way."""
    lengths = np.diff(ends, prepend=0)
    entries = np.repeat(keep, lengths)
    return np.cumsum(lengths[keep]), places[entries], numbers[entries]


def _residuals(loss: str, z: np.ndarray, labels: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss per class, and its derivative by the margins (rows x classes)."""
    rows = np.arange(len(labels))
    if loss == "softmax":
        top = z.max(axis=1, keepdims=True)
        p = np.exp(z - top)
        total = p.sum(axis=1, keepdims=True)
        value = np.zeros(z.shape[1])
        value[0] = float((np.log(total[:, 0]) + top[:, 0] - z[rows, labels]).sum())
        p /= total
        p[rows, labels] -= 1
        return value, p
    y = _signs(labels, classes)
    if loss == "squared_hinge":
        gap = np.maximum(1 - y * z, 0)
        return (gap**2).sum(axis=0), -2 * y * gap
    return np.logaddexp(0, -y * z).sum(axis=0), -y / (1 + np.exp(y * z))


def _curved(loss: str, z: np.ndarray, labels: np.ndarray, classes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The second derivative of the loss by the margins, times a change of margins."""
    if loss == "softmax":
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p * u - p * (p * u).sum(axis=1, keepdims=True)
    if loss == "squared_hinge":
        return 2 * u * (_signs(labels, classes) * z < 1)
    p = 1 / (1 + np.exp(-np.abs(z)))
    return p * (1 - p) * u


def _signs(labels: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """1 for the own class and -1 for the others."""
    return np.where(labels[:, None] == classes, 1.0, -1.0)


@dataclass(frozen=True)
class Problem:
    rows: DataFrame  # packed
    size: int
    classes: int
    loss: str
    c: float
    free_intercept: bool

    def _scan(self, w: np.ndarray, v: np.ndarray | None, going: np.ndarray) -> np.ndarray:
        """Column sums of the residuals of all rows, and the loss in the last row, for the classes that are ``going``; zero for others."""
        at = np.flatnonzero(going) if self.loss != "softmax" else np.arange(self.classes)
        loss, k, size = self.loss, len(at), self.size
        classes = at if self.classes > 1 else np.array([1])  # a single column stands for class 1
        shared = self.rows.sparkSession.sparkContext.broadcast(w[:, at] if v is None else np.hstack([w[:, at], v[:, at]]))

        def task(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray) -> None:
            for row in zip(*(batch.column(i) for i in range(5))):
                labels, ends, columns, places, numbers = (
                    np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int32, np.int64, np.int32, np.int32, np.float64)))
                near = shared.value[columns]
                if v is not None and loss == "squared_hinge":
                    margins = _margins(ends, places, numbers, np.ascontiguousarray(near[:, :k]))
                    inside = (_signs(labels, classes) * margins < 1).any(axis=1)
                    labels, (ends, places, numbers) = labels[inside], _rows_of(inside, ends, places, numbers)
                    margins = np.hstack([margins[inside], _margins(ends, places, numbers, np.ascontiguousarray(near[:, k:]))])
                else:
                    margins = _margins(ends, places, numbers, near)
                if v is None:
                    value, change = _residuals(loss, margins, labels, classes)
                    total[size + 1] += value
                    touched[size + 1] = True
                else:
                    change = _curved(loss, margins[:, :k], labels, classes, margins[:, k:])
                lengths, at = np.diff(ends, prepend=0), places.astype(np.int64)
                total[columns] += np.column_stack([np.bincount(at, numbers * np.repeat(change[:, c], lengths), len(columns)) for c in range(k)])
                touched[columns] = True

        out = np.zeros((size + 2, self.classes))
        out[:, at] = added(self.rows, task, size + 2, k, BLOCK)
        shared.unpersist()
        return out

    def _penalised(self, w: np.ndarray) -> np.ndarray:
        out = w.copy()
        if self.free_intercept:
            out[self.size] = 0
        return out

    def _dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per class, or over all classes when they depend on each other."""
        per_class = (a * b).sum(axis=0)
        return np.full(self.classes, per_class.sum()) if self.loss == "softmax" else per_class

    def value_and_gradient(self, w: np.ndarray, going: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._scan(w, None, going)
        loss = found[-1].sum() if self.loss == "softmax" else found[-1]
        penalised = self._penalised(w)
        return self._dot(penalised, penalised) / 2 + self.c * loss, penalised + self.c * found[:-1]

    def curvature(self, w: np.ndarray, v: np.ndarray, active: np.ndarray) -> np.ndarray:
        return self._penalised(v) + self.c * self._scan(w, v, active)[:-1]

    def direction(self, w: np.ndarray, gradient: np.ndarray, accuracy: np.ndarray, limit: int = 50) -> np.ndarray:
        """The Newton step by conjugate gradients, down to a share ``accuracy`` of the gradient's length."""
        step, rest = np.zeros_like(w), -gradient
        along, size = rest.copy(), self._dot(rest, rest)
        goal = accuracy**2 * size
        for _ in range(limit):
            active = size > goal
            if not active.any():
                break
            curved = self.curvature(w, along, active)
            bend = self._dot(along, curved)
            move = np.where(active & (bend > 0), size / np.where(bend > 0, bend, 1), 0)
            step += move * along
            rest -= move * curved
            now = self._dot(rest, rest)
            along = rest + np.where(active, now / np.where(size > 0, size, 1), 0) * along
            size = np.where(active, now, size)
        return step


def _gathered(packed: DataFrame, entries: int, numbers: int) -> DataFrame:
    """``packed`` in as many partitions as there are cores, or as many as read ``SHARE`` entries per coefficient.

    A task returns up to as many numbers as there are coefficients, whatever it has read; one for every part of the files would make
    what is moved and added in a scan grow far beyond what is read.
    """
    return packed.coalesce(int(max(packed.sparkSession.sparkContext.defaultParallelism, entries // (SHARE * numbers))))


def fit(entries: DataFrame, size: int, classes: int, loss: str, c: float, free_intercept: bool = True, tol: float = 1e-4,
        max_iter: int = 100) -> np.ndarray:
    """Coefficients (size + 1 x classes, intercepts last) for ``label`` (a class number), ``indices, values``.

    Rows without a label are left out. ``classes`` 1 means two classes with one set of coefficients, for class 1. Stops where the
    gradient of every class is ``tol`` of what it was at zero.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if (size + 2) * classes > MAX_NUMBERS:
        raise ValueError(f"{size} columns for {classes} classes; hash them into fewer columns first")
    rows = entries.where("label is not null").select(F.col("label").cast("int").alias("label"), "indices", "values")
    packed = stage(rows.mapInArrow(_pack_task(size), "labels binary, ends binary, columns binary, places binary, numbers binary"), "linear-rows")
    held = packed.agg(F.sum(F.length("places")) / 4).first()[0] or 0
    packed = _gathered(packed, int(held), (size + 2) * classes)
    return minimum(Problem(packed, size, classes, loss, c, free_intercept), tol, max_iter)


@contextlib.contextmanager
def _scanning(spark: SparkSession) -> Iterator[None]:
    """Within it, few blocks make a batch; ten thousand, Spark's own number of rows, would hold all that a task reads."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def minimum(problem: Problem, tol: float, max_iter: int) -> np.ndarray:
    """The coefficients with the lowest objective, to a share ``tol`` of the gradient at zero."""
    with _scanning(problem.rows.sparkSession):
        return _minimum(problem, tol, max_iter)


def _minimum(problem: Problem, tol: float, max_iter: int) -> np.ndarray:
    w, going = np.zeros((problem.size + 1, problem.classes)), np.ones(problem.classes, bool)
    value, gradient = problem.value_and_gradient(w, going)
    start = np.sqrt(problem._dot(gradient, gradient))
    for _ in range(max_iter):
        length = np.sqrt(problem._dot(gradient, gradient))
        going = length > tol * start
        if not going.any():
            return w
        share = length / np.where(start > 0, start, 1)
        step = problem.direction(w, np.where(going, gradient, 0), np.minimum(0.1, np.sqrt(share)))
        slope, scale = problem._dot(gradient, step), np.ones(problem.classes)
        for _ in range(30):
            found = problem.value_and_gradient(w + scale * step, going)
            new_value, new_gradient = (np.where(going, new, old) for new, old in zip(found, (value, gradient)))
            worse = new_value > value + 1e-4 * scale * slope + 1e-12 * np.abs(value)
            if not worse.any():
                break
            scale = np.where(worse, scale / 2, scale)
        if (new_value >= value - 1e-12 * np.abs(value)).all():
            return w + scale * step  # as far as numbers of this precision tell
        w, value, gradient = w + scale * step, new_value, new_gradient
    warnings.warn(f"{problem.loss} stopped at its limit of {max_iter} Newton steps", stacklevel=4)
    return w
