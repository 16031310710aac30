"""Boosted trees against splits and trees found by trying everything."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import boosting


def slow_split(gradients, curves, bins, categorical, min_rows):
    """The best gain over all cuts, for categories over all subsets, with missing values on either side."""
    best = 0.0
    worth = lambda rows: gradients[rows].sum() ** 2 / (curves[rows].sum() + 1e-12)
    for f in range(bins.shape[1]):
        there = np.unique(bins[bins[:, f] != boosting.MISSING, f])
        if categorical[f]:
            groups = [g for n in range(1, len(there) + 1) for g in itertools.combinations(there, n)]
        else:
            groups = [there[:n] for n in range(1, len(there) + 1)]
        for group, gap in itertools.product(groups, [(), (boosting.MISSING,)]):
            rows = np.isin(bins[:, f], list(group) + list(gap))
            if min(rows.sum(), (~rows).sum()) >= min_rows:
                best = max(best, worth(rows) + worth(~rows) - worth(slice(None)))
    return best


def table(seed, rows=300, classes=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, rows), rng.integers(0, 12, rows), rng.random(rows).round(1)]).astype(float)
    score = np.isin(x[:, 0], [1, 4]) * 2.0 + (x[:, 1] > 7) + rng.random(rows)
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[y == 0, 2] = np.where(rng.random((y == 0).sum()) < 0.5, np.nan, x[y == 0, 2])  # missing values that tell something
    return x, y


def frame(spark, x, y):
    rows = [(i, None if l is None else int(l), [None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, (r, l) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>").repartition(3)


@pytest.mark.parametrize("seed", range(6))
def test_splits_are_the_best_ones(seed):
    x, y = table(seed)
    cuts = [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
    bins = boosting.binned(x, cuts)
    gradients, curves = (d[:, 0] for d in boosting.derivatives(np.full((len(y), 1), 0.3), y))
    categorical = np.array([True, False, False])
    cells = np.zeros((1, 3, boosting.BINS, 3))
    for f in range(3):
        for k, weights in enumerate((gradients, curves, None)):
            cells[0, f, :, k] = np.bincount(bins[:, f], weights, boosting.BINS)
    feature, left, sums = boosting.best_splits(cells, categorical, 0.0, 20)
    rows = left[0, bins[:, feature[0]]]
    assert sums[0, 0] == pytest.approx([gradients[rows].sum(), curves[rows].sum(), rows.sum()])
    assert sums[0, 1] == pytest.approx([gradients[~rows].sum(), curves[~rows].sum(), (~rows).sum()])
    gain = sum(s[0] ** 2 / s[1] for s in sums[0]) - gradients.sum() ** 2 / curves.sum()
    assert gain == pytest.approx(slow_split(gradients, curves, bins, categorical, 20))


@pytest.mark.parametrize("classes, direct", [(2, True), (2, False), (3, True)])
def test_scans_over_tasks_equal_one_table(spark, monkeypatch, classes, direct):
    """The same trees as from the whole table at once, however its rows are dealt, packed and staged."""
    monkeypatch.setattr(boosting, "CELLS", 150)
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    if not direct:
        monkeypatch.setattr(boosting, "DIRECT_NUMBERS", 0)
    x, y = table(7, classes=classes)
    model = boosting.fit(frame(spark, x, y), 3, classes, [0], rounds=5, depth=3)
    trees, bins, categorical = model.base.size, boosting.binned(x, model.cuts), np.array([True, False, False])
    margins = np.tile(model.base, (len(y), 1))
    assert len(model.rounds) == 5
    for grown in model.rounds:
        derived = boosting.derivatives(margins, y)
        for t, tree in enumerate(grown):
            for level in range(3):
                node = boosting.nodes_at(bins, tree.feature, tree.left, level)
                for n in np.unique(node):
                    mine, inner = node == n, n + (1 << level) - 1
                    gradients, curves = (d[mine, t] for d in derived)
                    want = slow_split(gradients, curves, bins[mine], categorical, 20)
                    if tree.feature[inner] < 0:
                        assert want == pytest.approx(0, abs=2 * boosting.MIN_GAIN)
                        continue
                    rows = tree.left[inner, bins[mine, tree.feature[inner]]]
                    gain = sum(gradients[r].sum() ** 2 / curves[r].sum() for r in (rows, ~rows)) - gradients.sum() ** 2 / curves.sum()
                    assert gain == pytest.approx(want, abs=boosting.MIN_GAIN)
        margins = margins + np.column_stack([tree.margins(bins) for tree in grown])
    raw = {r["row_id"]: r["raw"] for r in model.probabilities(frame(spark, x, y)).collect()}
    odds = np.hstack([np.zeros_like(margins), margins]) if trees == 1 else margins
    expected = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
    assert np.allclose([raw[i] for i in range(len(y))], expected)
    assert (expected.argmax(axis=1) == y).mean() > 0.75


def test_missing_values_alone_tell_the_classes_apart(spark):
    x = np.full((200, 1), np.nan)
    x[::2, 0] = np.arange(100)
    y = np.arange(200) % 2
    model = boosting.fit(frame(spark, x, y), 1, 2, rounds=30, depth=2)
    raw = np.array([r["raw"] for r in model.probabilities(frame(spark, x, y)).orderBy("row_id").collect()])
    assert (raw.argmax(axis=1) == y).all() and raw.max(axis=1).min() > 0.9


def test_odd_tables(spark):
    x, y = table(1, rows=60)
    nothing = frame(spark, x[:1], [None])
    empty = boosting.fit(nothing, 3, 2, [0], rounds=3)
    assert empty.rounds == [] and empty.probabilities(nothing).first()["raw"] == [0.5, 0.5]
    one_class = boosting.fit(frame(spark, x, np.ones(60)), 3, 2, rounds=3)
    assert one_class.rounds == [] and one_class.probabilities(nothing).first()["raw"][1] > 0.99
    few = boosting.fit(frame(spark, x[:30], y[:30]), 3, 2, rounds=3)
    assert few.rounds == []  # no side may have fewer than 20 rows
    unlabelled = boosting.fit(frame(spark, np.vstack([x, x]), [*y, *[None] * 60]), 3, 2, [0], rounds=3)
    alone = boosting.fit(frame(spark, x, y), 3, 2, [0], rounds=3)
    assert np.allclose(unlabelled.margins(x), alone.margins(x))
    assert alone.probabilities(frame(spark, x, y).limit(0)).count() == 0
    constant = boosting.fit(frame(spark, np.ones((60, 2)), y), 2, 2, rounds=3)
    assert constant.rounds == []
    with pytest.raises(ValueError):
        boosting.fit(nothing, 5000, 2, depth=6)
    with pytest.raises(ValueError):
        boosting.fit(nothing, 0, 2)


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_paths_lead_where_the_splits_lead(depth):
    """A look-up per feature finds the node that walking level by level finds, also past nodes without a split."""
    rng = np.random.default_rng(depth)
    inner = (1 << depth) - 1
    feature, left = rng.integers(-1, 4, inner), rng.random((inner, boosting.BINS)) < 0.5
    left[feature < 0] = True
    bins = rng.integers(0, boosting.BINS, (500, 4)).astype(np.uint8)
    got = boosting._reached(boosting._paths(feature, left, 4, depth), boosting._columns(bins))
    assert (got == boosting.nodes_at(bins, feature, left, depth)).all()
