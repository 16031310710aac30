"""K-means for many numbers of clusters and many starts at once: a scan of the rows serves all of them."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.sums import added

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCANS = 100  # limit on the scans that move centres
TOLERANCE = 1e-4  # a model stands still when a scan lowers its cost by less than this share
ROUNDS = 2  # of drawing rows far from the centres known so far
CHUNK = 4096  # rows measured together in a task
SUM_BLOCK = 64


@dataclass(frozen=True)
class Clustering:
    """``sizes``, ``sums`` and ``squares`` (of lengths) describe the rows nearest to each centre."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @property
    def k(self) -> int:
        return len(self.centres)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    x = _matrix(batch, width)
    for start in range(0, len(x), CHUNK):
        yield x[start : start + CHUNK]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def _first_nearest(distances: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least distance of every row (centres x rows), and in ``own`` a one at the first centre that has it."""
    least = distances.min(axis=0)
    np.equal(distances, least, out=own)
    tied = np.flatnonzero(own.sum(axis=0) > 1)
    if len(tied):
        own[:, tied] = np.arange(len(own))[:, None] == own[:, tied].argmax(axis=0)
    return least


def _bounds(models: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(m) for m in models]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _measured(rows: DataFrame, models: Sequence[np.ndarray]) -> list[Clustering]:
    """In one scan: what the rows nearest to each centre of each model add up to. A tie goes to the first centre."""
    stacked, bounds = np.vstack(models), _bounds(models)
    width = stacked.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(stacked)

    def task(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray) -> None:
        centres = shared.value
        lengths = (centres * centres).sum(axis=1)[:, None]
        mine = np.empty((len(centres), CHUNK))
        for x in _chunks(batch, width):
            squares, own = (x * x).sum(axis=1), mine[:, : len(x)]
            distances = centres @ x.T  # centres x rows: what is compared lies side by side for many rows
            distances *= -2.0
            distances += squares
            distances += lengths
            np.maximum(distances, 0.0, out=distances)
            for a, b in bounds:
                total[a, width + 2] += _first_nearest(distances[a:b], own[a:b]).sum()
            total[:, : width + 2] += own @ np.column_stack([x, np.ones(len(x)), squares])
            touched[:] = True

    found = added(rows.select("features"), task, len(stacked), width + 3, SUM_BLOCK)
    shared.unpersist()
    return [Clustering(stacked[a:b], float(found[a:b, width + 2].sum()), found[a:b, width], found[a:b, :width], found[a:b, width + 1])
            for a, b in bounds]


def _moved(model: Clustering) -> np.ndarray:
    """The means of the rows; a centre without rows stays."""
    full = model.sizes[:, None] > 0
    return np.where(full, model.sums / np.maximum(model.sizes, 1)[:, None], model.centres)


def _drawn(rows: DataFrame, pool: np.ndarray, cost: float, wanted: int, seed: int) -> np.ndarray:
    """About ``wanted`` rows, each drawn in proportion to its squared distance from the pool. The chance hangs on the row's id."""
    shared = rows.sparkSession.sparkContext.broadcast(pool)
    width = pool.shape[1]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, chance = _matrix(batch, width), batch.column("chance").to_numpy()
            for start in range(0, len(x), CHUNK):
                part = x[start : start + CHUNK]
                share = wanted * _distances(part, shared.value).min(axis=1) / cost
                kept = np.flatnonzero(chance[start : start + CHUNK] < share) + start
                if len(kept):
                    yield batch.select(["features"]).take(pa.array(kept))

    chance = F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    found = rows.select("features", chance.alias("chance")).mapInArrow(chosen, "features array<double>").toArrow()
    shared.unpersist()
    return np.array(found["features"].to_pylist(), float).reshape(-1, width)


def _start(pool: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres from the weighted pool, each drawn in proportion to weight and squared distance; fewer when no other point is left."""
    picked = [int(rng.choice(len(pool), p=weights / weights.sum()))]
    while len(picked) < k:
        far = weights * _distances(pool, pool[picked]).min(axis=1)
        far[picked] = 0.0
        if far.sum() <= 0:
            break
        picked.append(int(rng.choice(len(pool), p=far / far.sum())))
    return pool[picked]


def fit(rows: DataFrame, ks: Sequence[int], restarts: int, seed: int, scans: int = SCANS, tolerance: float = TOLERANCE) -> dict[int, Clustering]:
    """For every k, the clustering of lowest cost among ``restarts`` starts.

    ``rows``: row_id, features (array<double> of one width). They are scanned a few times for a pool of starting points, drawn in
    proportion to squared distance and weighted by the rows near each, and then once for every step of all models together; models that
    stand still leave. Scans so do not grow with the numbers of clusters and starts. The driver holds the centres, about 2 x ROUNDS x
    max(ks) x restarts points of the pool and the sums of one scan. With fewer distinct rows than k there are fewer centres.
    """
    order = F.struct(F.xxhash64("row_id", F.lit(seed)), "row_id")
    first = rows.agg(F.min_by("features", order).alias("f")).first()["f"]
    if first is None:
        raise ValueError("no rows to cluster")
    pool = np.array([first], float)
    for i in range(ROUNDS):
        cost = sum(m.cost for m in _measured(rows, [pool]))
        if cost <= 0:
            break
        pool = np.unique(np.vstack([pool, _drawn(rows, pool, cost, 2 * max(ks) * restarts, seed + 1 + i)]), axis=0)
    near = _measured(rows, [pool])[0]
    rng = np.random.default_rng(seed)
    models = [(k, _start(pool, np.maximum(near.sizes, 1e-9), k, rng)) for k in ks for _ in range(restarts)]

    moving = [(k, centres, np.inf) for k, centres in models]
    done: list[tuple[int, np.ndarray]] = []
    for _ in range(scans):
        moved = []
        for (k, _, before), found in zip(moving, _measured(rows, [centres for _, centres, _ in moving])):
            if before - found.cost <= tolerance * found.cost:
                done.append((k, _moved(found)))
            else:
                moved.append((k, _moved(found), found.cost))
        moving = moved
        if not moving:
            break
    best: dict[int, Clustering] = {}
    models = done + [(k, centres) for k, centres, _ in moving]
    for (k, _), found in zip(models, _measured(rows, [c for _, c in models])):
        if k not in best or found.cost < best[k].cost:
            best[k] = found
    return {k: best[k] for k in ks}


def silhouettes(rows: DataFrame, models: Sequence[Clustering]) -> list[float]:
    """The mean silhouette of each clustering by squared Euclidean distance, over all rows and in one scan.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum and squares. A row alone in its cluster counts 0,
    and so does every row when there is one cluster only.
    """
    bounds, width = _bounds([m.centres for m in models]), models[0].centres.shape[1]
    stacked = np.vstack([m.centres for m in models])
    sizes, squares = (np.concatenate([getattr(m, name) for m in models]) for name in ("sizes", "squares"))
    sums = np.vstack([m.sums for m in models])
    shared = rows.sparkSession.sparkContext.broadcast((stacked, sizes, sums / np.maximum(sizes, 1)[:, None], squares / np.maximum(sizes, 1)))

    def task(batch: pa.RecordBatch, total: np.ndarray, touched: np.ndarray) -> None:
        centres, n, means, spread = shared.value
        for x in _chunks(batch, width):
            nearest = _distances(x, centres)
            apart = (x * x).sum(axis=1)[:, None] + spread - 2.0 * (x @ means.T)
            apart[:, n == 0] = np.inf
            at = np.arange(len(x))
            for i, (a, b) in enumerate(bounds):
                own = a + nearest[:, a:b].argmin(axis=1)
                inside = apart[at, own] * n[own] / np.maximum(n[own] - 1, 1)
                others = apart[:, a:b].copy()
                others[at, own - a] = np.inf
                outside = others.min(axis=1)
                top = np.maximum(inside, outside)
                counts = (n[own] > 1) & np.isfinite(outside) & (top > 0)
                total[i, 0] += ((outside - inside)[counts] / top[counts]).sum()
                total[i, 1] += len(x)
            touched[:] = True

    found = added(rows.select("features"), task, len(models), 2, SUM_BLOCK)
    shared.unpersist()
    return [float(s / n) if n else 0.0 for s, n in found]
