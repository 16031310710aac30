from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import cluster, kmeans, models, svd
from evalspark.operators.stacking import Stage2, stack
from evalspark.plans import catalog
from evalspark.plans.catalog import DOC_QUALITY, IRIS


@pytest.mark.parametrize("decay", [0.0, 0.5, 1.0])
def test_svd_captures_the_energy_of_a_dense_one(spark, decay):
    rng = np.random.default_rng(9)
    dense = rng.random((600, 150)) * (rng.random((600, 150)) < 0.1) * (1 + np.arange(150)) ** -decay
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    entries = spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>").repartition(5)
    vectors = svd.right_vectors(entries, 150, 10)
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-9
    best = (np.linalg.svd(dense, compute_uv=False)[:10] ** 2).sum()
    assert ((dense @ vectors) ** 2).sum() >= 0.99 * best


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 40)) * (rng.random((60, 40)) < 0.4)
    dense[5] = 0
    rows = []
    for i, r in enumerate(dense):
        idx = np.flatnonzero(r)
        rows.append((i, idx.tolist(), r[idx].tolist()))
    entries = spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>").repartition(3)
    got = {r["row_id"]: r["features"] for r in svd.svd_features(entries, 40, 5).collect()}
    got = np.array([got[i] for i in range(60)])
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :5] * s[:5]), rel=0.02, abs=0.02)


def test_svd_scans_against_dense(spark):
    """A scan is the product with A' A, and rows may be long, empty or name a column twice."""
    rng = np.random.default_rng(6)
    dense = rng.random((30, 50)) * (rng.random((30, 50)) < 0.4)
    dense[3] = 0
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    rows.append((30, [7, 2, 7], [1.0, 2.0, 0.5]))
    twice = np.zeros(50)
    twice[[2, 7]] = 2.0, 1.5
    dense = np.vstack([dense, twice])
    entries = spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>").repartition(3)
    basis = rng.random((50, 4))
    assert svd._gram_times(entries, basis) == pytest.approx(dense.T @ dense @ basis, rel=1e-4)
    got = {r["row_id"]: r["features"] for r in svd.project(entries, basis).collect()}
    assert np.array([got[i] for i in range(31)]) == pytest.approx(dense @ basis)


def test_cells_and_representatives_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.integers(3)), int(rng.integers(4)), bool(rng.random() < 0.3), rng.normal(size=3).tolist()) for i in range(120)]
    rows += [(200, "9", 0, False, [0.0] * 3), (201, "9", 0, False, [1.0] * 3)]  # a cell of two rows
    rows += [(300 + i, "8", 1, False, [float(i)] * 3) for i in range(3)]  # three rows, none short
    df = spark.createDataFrame(rows, "row_id long, label string, cluster int, short boolean, features array<double>")
    got = {(r["label"], r["cluster"]): r for r in cluster.cell_representatives(df).collect()}
    cells = {}
    for r in rows:
        cells.setdefault((r[1], r[2]), []).append(r)
    assert set(got) == {c for c, members in cells.items() if len(members) >= 3}
    for c, r in got.items():
        members = cells[c]
        centre = np.mean([m[4] for m in members], axis=0)
        pool = [m for m in members if m[3]] or members
        want = min(pool, key=lambda m: (np.linalg.norm(np.array(m[4]) - centre), m[0]))
        size = sum(len(v) for (_, k), v in cells.items() if k == c[1])
        assert r["row_id"] == want[0] and r["cell_size"] == len(members) and r["cluster_size"] == size
        assert r["label_share"] == pytest.approx(len(members) / size, abs=5e-4)


def blobs(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(c * n + i, rng.normal((c * 8.0, -c * 5.0), 0.5).tolist()) for c in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, features array<double>")


def test_choose_k_finds_the_groups(spark):
    vectors = blobs(spark).cache()
    model, scores = cluster.choose_k(vectors, min_k=2)
    assert model.k == 3 and set(scores) == set(range(2, 9))
    model, scores = cluster.choose_k(vectors, min_k=10, restarts=1)
    assert set(scores) == {10}


def test_a_tie_goes_to_the_first_centre():
    distances = np.array([[1.0, 3.0, 2.0], [1.0, 2.0, 2.0], [4.0, 2.0, 0.0]])  # centres x rows
    own = np.full((3, 3), 9.0)
    assert kmeans._first_nearest(distances, own).tolist() == [1.0, 2.0, 0.0]
    assert own.tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_clusterings_and_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1.0, size=(50, 4)) for c in rng.normal(0, 4, size=(5, 4))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(5).cache()
    found = kmeans.fit(df, range(2, 8), 4, 42, tolerance=0.0)
    scores = kmeans.silhouettes(df, list(found.values()))
    distances = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for (k, model), score in zip(found.items(), scores):
        near = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2)
        own = near.argmin(axis=1)
        assert model.cost == pytest.approx(near.min(axis=1).sum()) and model.sizes.tolist() == np.bincount(own, minlength=k).tolist()
        for c in range(k):  # a fixed point: every centre is the mean of the rows nearest to it
            assert model.centres[c] == pytest.approx(x[own == c].mean(axis=0))
        want = []
        for i in range(len(x)):
            mean = [distances[i, own == c].sum() / max((own == c).sum() - (c == own[i]), 1) for c in range(k)]
            a, b = mean[own[i]], min(m for c, m in enumerate(mean) if c != own[i])
            want.append((b - a) / max(a, b) if (own == own[i]).sum() > 1 else 0.0)
        assert score == pytest.approx(np.mean(want))
    costs = [m.cost for m in found.values()]
    assert costs == sorted(costs, reverse=True)


def test_scans_do_not_grow_with_clusters_and_starts(spark, monkeypatch):
    df, widths = blobs(spark).cache(), []
    plain = kmeans.added
    monkeypatch.setattr(kmeans, "added", lambda rows, task, *shape, **kw: widths.append(shape[0]) or plain(rows, task, *shape, **kw))
    kmeans.fit(df, range(2, 9), 4, 42, scans=6)
    assert len(widths) <= 3 + 6 + 1 and max(widths) >= 4 * sum(range(2, 9))


def test_few_distinct_rows_and_none(spark):
    same = spark.createDataFrame([(i, [float(i % 2)]) for i in range(20)], "row_id long, features array<double>")
    found = kmeans.fit(same, [2, 5], 2, 42)
    assert found[5].k == 2 and found[5].cost == 0 and kmeans.silhouettes(same, [found[2]]) == [1.0]
    one = kmeans.fit(same.where("row_id % 2 = 0"), [3], 2, 42)[3]
    assert one.k == 1 and kmeans.silhouettes(same.where("row_id % 2 = 0"), [one]) == [0.0]
    with pytest.raises(ValueError, match="no rows"):
        kmeans.fit(same.where("row_id < 0"), [2], 2, 42)


def test_table_features_are_standardised_and_one_hot(spark):
    rows = [(i, float(i) if i % 5 else None, "a" if i < 15 else ("b" if i < 27 else "rare")) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string")
    got = np.array([r["features"] for r in cluster.table_features(df, ["x"], ["c"]).orderBy("row_id").collect()])
    assert got.shape == (30, 4)  # x, a, b, everything rare
    assert got[:, 0].mean() == pytest.approx(0, abs=1e-9) and got[:, 0].std() == pytest.approx(1)
    assert got[:, 1:].sum(axis=1).tolist() == [1.0] * 30 and sorted(got[:, 1:].sum(axis=0)) == [3, 12, 15]


def newton_logistic(x, y, c=1.0):
    """Reference solution of the L2 objective with summed loss and a free intercept."""
    a = np.c_[x, np.ones(len(x))]
    w, reg = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(c * a.T @ (a * (p * (1 - p))[:, None]) + reg, c * a.T @ (p - y) + reg @ w)
    return w


def test_stage2_solves_the_summed_loss_objective(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2)) * (3, 0.5) + (1, 2)
    y = (x[:, 0] + rng.normal(size=200) > 1).astype(int)
    df = spark.createDataFrame([(i, str(y[i]), x[i].tolist()) for i in range(200)], "row_id long, label string, features array<double>")
    model = Stage2.fit(DOC_QUALITY, df, 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = newton_logistic(z, y)
    assert list(model.model.coefficients) == pytest.approx(list(want[:2]), abs=1e-3)
    p = {r["row_id"]: r["score"] for r in model.predict(df).collect()}
    assert [p[i] for i in range(200)] == pytest.approx(list(1 / (1 + np.exp(-np.c_[z, np.ones(200)] @ want))), abs=1e-3)


def test_oof_scores_cover_every_row_once(spark, public_files):
    rows = catalog.CATALOG["iris"].load(spark, public_files)
    oof, probabilistic = models.oof_scores(IRIS, rows)
    assert probabilistic and oof.count() == 150 and oof.select("row_id").distinct().count() == 150
    got = oof.join(rows.select("row_id", "label"), "row_id").collect()
    right = sum(IRIS.labels[int(np.argmax(r["raw"]))] == r["label"] for r in got)
    assert right > 135 and all(sum(r["raw"]) == pytest.approx(1) for r in got)


def test_naive_bayes_without_a_fold_equals_a_refit(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[:30] if i % 3 else words[10:], size=rng.integers(1, 12))) for i in range(90)]
    texts += ["only here", "", None, "!"]  # words of one fold alone, and texts without words
    labels = [str(int(i % 3 == 0)) for i in range(92)] + ["unlisted"]
    rows = spark.createDataFrame(list(zip(range(93), texts, labels)), "row_id long, text string, label string").repartition(4)
    folded = rows.withColumn("fold", F.when(F.col("row_id") != 7, (F.col("row_id") % 5).cast("int")))
    bayes = models.NaiveBayes()
    got, probabilistic = bayes.out_of_fold(DOC_QUALITY, folded, 5)
    want, _ = models.refitted_scores(DOC_QUALITY, bayes.prepare(DOC_QUALITY, folded), bayes, 5)
    got, want = ({r["row_id"]: (r["fold"], *r["raw"]) for r in df.collect()} for df in (got, want))
    assert probabilistic and set(got) == set(want) == set(range(93)) - {7}
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_control_does_not_see_the_judge(spark):
    rng = np.random.default_rng(5)
    n = 120
    y = rng.integers(0, 2, n)
    rows = spark.createDataFrame([(i, str(y[i])) for i in range(n)], "row_id long, label string")
    noise = spark.createDataFrame([(i, [0.5, 0.5 + 0.01 * float(rng.normal())]) for i in range(n)], "row_id long, raw array<double>")
    records = rows.select("row_id", F.when(F.col("label") == "1", 0.9).otherwise(0.1).alias("p_yes"), F.lit(None).cast("string").alias("error"))
    result = stack(DOC_QUALITY, rows.where("row_id < 80"), noise, noise.where("row_id >= 80"), True, records)
    pred = result.predictions.join(rows, "row_id").groupBy("method").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("a"))
    accuracy = {r["method"]: r["a"] for r in pred.collect()}
    assert accuracy["stacked"] == 1.0 and accuracy["control"] < 0.8
    assert result.train_rows == 80 and result.judge_missing == 0 and result.weights["judge"] > abs(result.weights["baseline"])
