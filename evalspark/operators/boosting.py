"""Gradient-boosted trees from histograms, with missing values as a bin of their own.

Values become bin numbers once (at most 255 bins per feature, cut at approximate quantiles, and one bin for missing values), and rows are
packed into blocks of bytes. A level of the trees of all classes is one scan: a task adds its rows' gradients, Hessians
and counts up per (tree, node, feature, bin), the sums of the tasks are added, and the driver picks the best split of every node. A
split sends a set of bins to the left: for numbers the bins up to a cut, for categories a prefix of the bins in the order of
their mean gradient; the side of the missing values is the better one of both. Margins are written with the rows every few
trees, so a scan applies only the trees since then.

The driver and a task hold one histogram (trees x nodes x features x 256 bins x 3 numbers), whatever the number of rows.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.sums import added
from evalspark.session import stage

# The functions run inside tasks travel with them, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH_DEPTH = 6  # the nodes of a level as bits of one number
MISSING = 255  # the bin of missing values; the others are 0 to 254
BINS = MISSING + 1
CELLS = 1 << 16  # bin numbers in a packed block
KEPT_TREES = 8  # rounds between two written margins
MAX_NUMBERS = 1 << 25  # of a histogram: 256 MB of doubles
MIN_GAIN = 1e-9  # what is below is rounding
DIRECT_NUMBERS = 1 << 23  # partial sums that go straight to the driver: 64 MB of doubles
PACKED = "labels binary, bins binary, margins binary"
PACKED_SCHEMA = pa.schema([(n, pa.binary()) for n in ("labels", "bins", "margins")])


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in level order. A node without a split (feature -1) sends all rows to the left."""

    feature: np.ndarray  # per inner node
    left: np.ndarray  # inner nodes x bins: goes to the left
    value: np.ndarray  # per leaf

    @functools.cached_property
    def depth(self) -> int:
        return int(len(self.value)).bit_length() - 1

    @functools.cached_property
    def paths(self) -> np.ndarray:
        return _paths(self.feature, self.left, int(self.feature.max(initial=0)) + 1, self.depth)

    def margins(self, bins: np.ndarray, columns: list[np.ndarray] | None = None) -> np.ndarray:
        if self.depth > PATH_DEPTH:
            return self.value[nodes_at(bins, self.feature, self.left, self.depth)]
        return self.value.take(_reached(self.paths, _columns(bins) if columns is None else columns))


def nodes_at(bins: np.ndarray, feature: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The node each row reaches at a depth, counted from 0 within its level."""
    cells, sides = bins.ravel(), left.ravel()
    starts, node = np.arange(0, bins.size, bins.shape[1]), np.zeros(len(bins), np.int64)
    tested = np.maximum(feature, 0)
    for level in range(depth):
        inner = node + ((1 << level) - 1)
        node = 2 * node + ~sides[inner * BINS + cells[starts + tested[inner]]]
    return node


def _paths(feature: np.ndarray, left: np.ndarray, features: int, depth: int) -> np.ndarray:
    """features x bins: the nodes of a depth, a bit each, that the splits on a feature leave to a row of that bin.

    A split that sends a row to the right rules out what lies below it on the left. The first node that no feature rules out is the row's.
    """
    out = np.full((features, BINS), np.uint64(2 ** (1 << depth) - 1))
    for inner in np.flatnonzero(feature[: (1 << depth) - 1] >= 0):
        level = int(inner + 1).bit_length() - 1
        half = 1 << (depth - level - 1)  # nodes below each side
        below = ((1 << half) - 1) << (2 * half * (int(inner) + 1 - (1 << level)))
        out[feature[inner], ~left[inner]] &= ~np.uint64(below)
    return out


def _reached(paths: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The node of each row by ``_paths``: a look-up per feature, whatever the depth."""
    open_ = paths[0].take(columns[0])
    for mine, column in zip(paths[1:], columns[1:]):
        open_ &= mine.take(column)
    first = open_ & (~open_ + np.uint64(1))
    return (first.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent of a power of two


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix of values; NaN is missing."""
    out = np.empty(values.shape, np.uint8)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, values[:, f])
        out[np.isnan(values[:, f]), f] = MISSING
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), features)


def _pack_task(cuts: list[np.ndarray], base: np.ndarray):
    """Rows as blocks of bytes: labels, bin numbers, margins."""
    limit = max(1, CELLS // len(cuts))

    def packed(labels: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
        margins = np.tile(base, (len(labels), 1))
        parts = [labels.tobytes(), bins.tobytes(), margins.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], schema=PACKED_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            bins = binned(_matrix(batch.column(1), len(cuts)), cuts)
            for at in range(0, len(labels), limit):
                held.append((labels[at:at + limit], bins[at:at + limit]))
                rows += len(held[-1][0])
                if rows >= limit:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, rows = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return task


def _unpacked(row: tuple, features: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    labels, bins, margins = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int32, np.uint8, np.float64)))
    return labels, bins.reshape(-1, features), margins.reshape(-1, trees)


def _columns(bins: np.ndarray) -> list[np.ndarray]:
    return [bins[:, f].astype(np.int64) for f in range(bins.shape[1])]


def _with_rounds(margins: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], columns: list[np.ndarray] | None = None) -> np.ndarray:
    if not rounds:
        return margins
    columns = _columns(bins) if columns is None else columns
    return margins + sum(np.column_stack([tree.margins(bins, columns) for tree in trees]) for trees in rounds)


def derivatives(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss; one column stands for class 1 of two."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return p - (labels == 1)[:, None], p * (1 - p)
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (labels[:, None] == np.arange(p.shape[1])), p * (1 - p)


@dataclass(frozen=True)
class Growing:
    """What a scan needs to know of the trees being grown."""

    rounds: list[list[Tree]]  # since margins were written
    parts: list[tuple[np.ndarray, np.ndarray]]  # feature and left of every tree of this round
    depth: int


def histogram(rows: DataFrame, blocks: int, features: int, trees: int, grown: Growing) -> np.ndarray:
    """trees x nodes x features x bins x (gradient, Hessian, count), in one scan of at most ``blocks`` tasks with rows."""
    nodes = 1 << grown.depth
    shape = (trees, nodes, features, BINS, 3)
    size = int(np.prod(shape[:-1]))
    shared = rows.sparkSession.sparkContext.broadcast(grown)

    def add(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray | None = None) -> None:
        now = shared.value
        paths = [_paths(*part, features, now.depth) for part in now.parts] if now.depth <= PATH_DEPTH else None
        for row in zip(*(batch.column(i) for i in range(3))):
            labels, bins, margins = _unpacked(row, features, trees)
            columns = _columns(bins)
            gradients, curves = derivatives(_with_rounds(margins, bins, now.rounds, columns), labels)
            for t in range(trees):
                start = (nodes_at(bins, *now.parts[t], now.depth) if paths is None else _reached(paths[t], columns)) * BINS
                for f in range(features):
                    cell = start + columns[f]
                    found = [np.bincount(cell, weights, nodes * BINS) for weights in (gradients[:, t], curves[:, t], None)]
                    at = (((t * nodes + np.arange(nodes)) * features + f)[:, None] * BINS + np.arange(BINS)).ravel()
                    total[at] += np.column_stack(found)
        if touched is not None:
            np.logical_or(touched, total[:, 2] > 0, out=touched)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 3))
        for batch in batches:
            add(batch, total)
        cells = np.flatnonzero(total[:, 2])
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary()), pa.array([total[cells].tobytes()], pa.binary())], ["cells", "part"])

    if blocks * size * 3 <= DIRECT_NUMBERS:
        out = np.zeros((size, 3))
        for cells, part in zip(*rows.mapInArrow(whole, "cells binary, part binary").toArrow().columns):
            out[np.frombuffer(cells.as_buffer(), np.int64)] += np.frombuffer(part.as_buffer(), float).reshape(-1, 3)
    else:
        out = added(rows, add, size, 3, BINS * 64)
    shared.unpersist()
    return out.reshape(shape)


def best_splits(cells: np.ndarray, categorical: np.ndarray, l2: float, min_rows: int, min_curve: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node of a histogram (nodes x features x bins x 3): feature or -1, the bins that go left, and the sums of both sides.

    The first of equally good splits wins: missing values to the right before left, then by feature, then by position.
    """
    nodes, features = cells.shape[:2]
    total = cells[:, 0].sum(axis=1)  # every feature holds every row
    present, gap = cells[:, :, :MISSING], cells[:, :, MISSING]
    order = np.broadcast_to(np.arange(MISSING), present.shape[:3]).copy()
    if categorical.any():
        mean = present[..., 0] / (present[..., 1] + 1e-12)
        mean[present[..., 2] == 0] = np.inf  # bins without rows come last
        order[:, categorical] = np.argsort(mean[:, categorical], axis=2, kind="stable")
    before = np.cumsum(np.take_along_axis(present, order[..., None], axis=2), axis=2)
    sides = np.stack([before, before + gap[:, :, None]], axis=1)  # nodes x side of missing x features x position x 3
    rest = total[:, None, None, None] - sides

    def worth(part: np.ndarray) -> np.ndarray:
        return part[..., 0] ** 2 / (part[..., 1] + l2 + 1e-12)

    gain = worth(sides) + worth(rest) - worth(total)[:, None, None, None]
    allowed = (np.minimum(sides[..., 2], rest[..., 2]) >= max(1, min_rows)) & (np.minimum(sides[..., 1], rest[..., 1]) >= min_curve)
    gain = np.where(allowed, gain, -np.inf).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    node = np.arange(nodes)
    feature = np.full(nodes, -1)
    left = np.ones((nodes, BINS), bool)
    sums = np.stack([total, np.zeros_like(total)], axis=1)
    good = gain[node, at] > MIN_GAIN
    side, column, place = np.unravel_index(at, sides.shape[1:4])
    for i in node[good]:
        f = column[i]
        feature[i] = f
        left[i] = False
        left[i, order[i, f, :place[i] + 1]] = True
        sums[i] = sides[i, side[i], f, place[i]], rest[i, side[i], f, place[i]]
        # without missing values they follow the larger side
        left[i, MISSING] = bool(side[i]) if gap[i, f, 2] else sums[i, 0, 2] >= sums[i, 1, 2]
    return feature, left, sums


@dataclass(frozen=True)
class Boosted:
    """``margins(values)`` of a fitted model: one column for two classes, else one per class."""

    cuts: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        return _with_rounds(np.tile(self.base, (len(bins), 1)), bins, self.rounds)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``row_id, raw``: class probabilities of rows with ``row_id, features``."""
        shared, layout = df.sparkSession.sparkContext.broadcast(self), df.select("row_id").schema
        features = len(self.cuts)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = shared.value.margins(_matrix(batch.column(1), features))
                z = np.hstack([np.zeros_like(z), z]) if z.shape[1] == 1 else z
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["row_id", "raw"])

        return df.select("row_id", "features").mapInArrow(task, f"row_id {layout['row_id'].dataType.simpleString()}, raw array<double>")


def fit(rows: DataFrame, features: int, classes: int, categorical: Sequence[int] = (), rounds: int = 100, depth: int = 5, step: float = 0.1,
        l2: float = 0.0, min_rows: int = 20) -> Boosted:
    """Trees for rows with ``label`` (a class number) and ``features`` (an array of doubles; null or NaN is missing).

    Rows without a label are left out. With no rows, or rows of one class, the model returns the classes' shares.
    """
    trees = 1 if classes == 2 else classes
    if trees * (features << (depth - 1)) * BINS * 3 > MAX_NUMBERS:
        raise ValueError(f"{features} features, {trees} trees of depth {depth}: a histogram would be too large")
    if not 1 <= features or not 1 <= depth:
        raise ValueError("at least one feature and one level are needed")
    value = [F.when(~F.isnan(F.col("features")[f]), F.col("features")[f]) for f in range(features)]
    known = rows.where(F.col("label").isNotNull()).select(F.col("label").cast("int").alias("label"), F.array(*value).alias("features"))
    shares = [i / MISSING for i in range(1, MISSING)]
    found = known.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("label") == c, 1)).alias(f"n{c}") for c in range(classes)],
                      *[F.percentile_approx(F.col("features")[f], shares).alias(f"cuts{f}") for f in range(features)]).first()
    counts = np.array([found[f"n{c}"] for c in range(classes)], float)
    prior = np.log(np.maximum(counts, 1e-9) / max(1.0, counts.sum()))
    base = prior[1:] - prior[:1] if trees == 1 else prior - prior.mean()
    cuts = [np.unique(np.array(found[f"cuts{f}"] or [], float)) for f in range(features)]
    if (counts > 0).sum() < 2:
        return Boosted(cuts, base if found["n"] else np.zeros(trees), [])
    # blocks are dealt evenly, so that every core has its share of each scan
    cores = rows.sparkSession.sparkContext.defaultParallelism
    packed = stage(known.mapInArrow(_pack_task(cuts, base), PACKED).repartition(cores), "boosting-rows")
    blocks = packed.count()
    is_category = np.isin(np.arange(features), list(categorical))
    done: list[list[Tree]] = []
    new: list[list[Tree]] = []
    for _ in range(rounds):
        grown = _grow(packed, blocks, features, trees, new, is_category, depth, step, l2, min_rows)
        if all((tree.feature < 0).all() for tree in grown):
            break  # nothing is left to split
        new.append(grown)
        if len(new) == KEPT_TREES and len(done) + len(new) < rounds:
            packed = stage(packed.mapInArrow(_apply_task(new, features, trees), PACKED), "boosting-rows")
            done, new = done + new, []
    return Boosted(cuts, base, done + new)


def _apply_task(rounds: list[list[Tree]], features: int, trees: int):
    """Packed blocks with the margins of more trees."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3))):
                labels, bins, margins = _unpacked(row, features, trees)
                parts = [labels.tobytes(), bins.tobytes(), _with_rounds(margins, bins, rounds).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], schema=PACKED_SCHEMA)

    return task


def _grow(packed: DataFrame, blocks: int, features: int, trees: int, rounds: list[list[Tree]], categorical: np.ndarray, depth: int, step: float, l2: float,
          min_rows: int) -> list[Tree]:
    """One tree per class, a level of all of them per scan."""
    feature = [np.zeros(0, np.int64) for _ in range(trees)]
    left = [np.zeros((0, BINS), bool) for _ in range(trees)]
    sums = [np.zeros((1, 2, 3))] * trees
    for level in range(depth):
        cells = histogram(packed, blocks, features, trees, Growing(rounds, list(zip(feature, left)), level))
        splits = [best_splits(cells[t], categorical, l2, min_rows) for t in range(trees)]
        feature = [np.r_[f, s[0]] for f, s in zip(feature, splits)]
        left = [np.vstack([l, s[1]]) for l, s in zip(left, splits)]
        sums = [s[2] for s in splits]
        if all((s[0] < 0).all() for s in splits):
            depth = level + 1
            break
    leaves = [s.reshape(2 << (depth - 1), 3) for s in sums]
    return [Tree(f, l, -step * v[:, 0] / (v[:, 1] + l2 + 1e-12)) for f, l, v in zip(feature, left, leaves)]
