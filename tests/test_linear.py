"""The linear models against dense solutions of their objectives."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.operators import linear


def data(spark, classes, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((240, 30)) * (rng.random((240, 30)) < 0.3)
    labels = (x[:, :classes] + 0.3 * rng.random((240, classes))).argmax(axis=1)
    rows = [(int(l), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for l, r in zip(labels, x)]
    rows.append((None, [0], [1.0]))  # without a label
    return x, labels, spark.createDataFrame(rows, "label int, indices array<int>, values array<double>").repartition(4)


def objective(w, x, labels, loss, c, free):
    a = np.c_[x, np.ones(len(x))]
    z, k = a @ w, w.shape[1]
    penalty = (w[:-1] ** 2).sum() / 2 + (0 if free else (w[-1] ** 2).sum() / 2)
    if loss == "softmax":
        return penalty + c * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).sum()
    y = np.where(labels[:, None] == (np.arange(k) if k > 1 else np.array([1])), 1, -1)
    return penalty + c * ((np.maximum(1 - y * z, 0) ** 2).sum() if loss == "squared_hinge" else np.logaddexp(0, -y * z).sum())


def slopes(w, *args):
    """The gradient by differences."""
    out = np.zeros_like(w)
    for at in np.ndindex(*w.shape):
        step = np.zeros_like(w)
        step[at] = 1e-5
        out[at] = (objective(w + step, *args) - objective(w - step, *args)) / 2e-5
    return out


@pytest.mark.parametrize("loss, classes, c, free", [
    ("squared_hinge", 3, 1.0, False), ("squared_hinge", 2, 10.0, True), ("log", 1, 4.0, True), ("softmax", 3, 2.0, True)])
def test_nothing_lowers_the_objective(spark, monkeypatch, loss, classes, c, free):
    """The objectives are convex (strongly, but for a free intercept), so a vanishing gradient means the minimum."""
    monkeypatch.setattr(linear, "ENTRIES", 200)
    x, labels, entries = data(spark, max(classes, 2), classes)
    w = linear.fit(entries, 30, classes, loss, c, free_intercept=free, tol=1e-6)
    args = (x, labels, loss, c, free)
    at_zero = slopes(np.zeros_like(w), *args)
    assert np.abs(slopes(w, *args)).max() < 1e-4 * np.abs(at_zero).max()
    # a gradient g leaves at most |g|^2 / 2 of a strongly convex objective; a looser stop stays within 1e-4 of it
    loose = linear.fit(entries, 30, classes, loss, c, free_intercept=free)
    assert objective(loose, *args) <= objective(w, *args) * (1 + 1e-4)


def test_partial_sums_do_not_grow_with_files(spark, monkeypatch):
    """Rows in many small files are read by as many tasks as there are cores, each with one partial sum."""
    found, added = [], linear.added
    monkeypatch.setattr(linear, "added", lambda rows, *args: found.append(rows.rdd.getNumPartitions()) or added(rows, *args))
    _, _, entries = data(spark, 3, 3)
    bytes_before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a file to a task
    try:
        linear.fit(entries.repartition(40), 30, 3, "log", 1.0, max_iter=1)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", bytes_before)
    assert found and max(found) <= spark.sparkContext.defaultParallelism


def test_margins_and_places_of_packed_rows():
    """A packed block multiplies like the dense matrix, rows without entries included."""
    rng = np.random.default_rng(4)
    dense = rng.random((50, 20)) * (rng.random((50, 20)) < 0.3)
    dense[7] = 0
    indices = [np.flatnonzero(r) for r in dense]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(50)), pa.array([i.tolist() for i in indices], pa.list_(pa.int32())),
         pa.array([r[i].tolist() for r, i in zip(dense, indices)], pa.list_(pa.float64()))], ["label", "indices", "values"])
    (block,) = linear._pack_task(20)(iter([batch]))
    labels, ends, columns, places, numbers = (
        np.frombuffer(block.column(i)[0].as_py(), t) for i, t in enumerate((np.int32, np.int64, np.int32, np.int32, np.float64)))
    w = rng.random((21, 3))
    assert columns[0] == 20 and labels.tolist() == list(range(50))
    assert linear._margins(ends, places, numbers, w[columns]) == pytest.approx(np.c_[dense, np.ones(50)] @ w)


def test_refuses_what_does_not_fit(spark):
    entries = spark.range(0).select(F.col("id").alias("label"), F.array().alias("indices"), F.array().alias("values"))
    with pytest.raises(ValueError):
        linear.fit(entries, 10, 2, "hinge", 1.0)
    with pytest.raises(ValueError):
        linear.fit(entries, linear.MAX_NUMBERS, 2, "log", 1.0)


def test_products_leave_out_what_adds_nothing(spark, monkeypatch):
    """A product with the Hessian of the squared hinge multiplies rows within the margin only, for the classes asked for; the sums are those of all rows."""
    x, labels, entries = data(spark, 3, 11)
    w, v = np.random.default_rng(1).normal(size=(2, 31, 3)) * 0.7
    ones = np.c_[x, np.ones(len(x))]
    y = np.where(labels[:, None] == np.arange(3), 1, -1)
    inside = y * (ones @ w) < 1
    want = 2 * ones.T @ (inside * (ones @ v))
    rows = entries.where("label is not null").coalesce(1)
    packed = rows.mapInArrow(linear._pack_task(30), "labels binary, ends binary, columns binary, places binary, numbers binary")
    problem = linear.Problem(packed, 30, 3, "squared_hinge", 1.0, True)
    sizes, added = [], linear.added

    def counted(df, task, rows, width, *args):
        sizes.append(width)
        return added(df, task, rows, width, *args)

    monkeypatch.setattr(linear, "added", counted)
    assert problem._scan(w, v, np.array([True, True, True]))[:-1] == pytest.approx(want)
    some = problem._scan(w, v, np.array([True, False, True]))[:-1]
    assert some[:, [0, 2]] == pytest.approx(want[:, [0, 2]]) and not some[:, 1].any()
    assert sizes == [3, 2]


def test_kept_rows_of_a_block():
    ends, places, numbers = np.array([2, 3, 3, 6]), np.array([4, 1, 0, 2, 3, 5], np.int32), np.arange(6.0)
    kept = linear._rows_of(np.array([False, True, True, True]), ends, places, numbers)
    assert [k.tolist() for k in kept] == [[1, 1, 4], [0, 2, 3, 5], [2.0, 3.0, 4.0, 5.0]]


def test_scans_read_few_blocks_at_once(spark, monkeypatch):
    """A batch of Spark's ten thousand rows would be all blocks of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found, added = spark.conf.get(key), [], linear.added
    monkeypatch.setattr(linear, "added", lambda *args: found.append(int(spark.conf.get(key))) or added(*args))
    _, _, entries = data(spark, 3, 3)
    linear.fit(entries, 30, 3, "squared_hinge", 1.0, tol=0.1)
    assert found and max(found) <= 4 and spark.conf.get(key) == before
