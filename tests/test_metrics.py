from __future__ import annotations

import random

import numpy as np
import pytest

from evalspark.functions import ordered
from evalspark.functions.ordered import exact_percentiles, running_totals
from evalspark.operators import metrics as m

SCHEMA = "label string, pred string, score double"


def measured(spark, rows, labels=("0", "1"), positive="1"):
    return m.metrics(spark.createDataFrame(rows, SCHEMA), labels, positive).first()


def brute_auc(rows):
    pos = [s for l, _, s in rows if l == "1"]
    neg = [s for l, _, s in rows if l == "0"]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_ties_count_half(spark):
    rows = [("1", "1", 0.5), ("0", "1", 0.5), ("1", "1", 0.5), ("0", "0", 0.1), ("0", "1", 0.5), ("1", "0", 0.1)]
    assert measured(spark, rows)["roc_auc"] == pytest.approx(brute_auc(rows))


def test_random_scores_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("01"), rng.choice("01"), round(rng.gauss(0, 2), 2)) for _ in range(1500)]
    got = measured(spark, rows)
    assert got["roc_auc"] == pytest.approx(brute_auc(rows))
    assert got["n"] == 1500
    assert got["accuracy"] == pytest.approx(sum(l == p for l, p, _ in rows) / 1500)
    f1 = []
    for c in "01":
        tp = sum(l == p == c for l, p, _ in rows)
        f1.append(2 * tp / (sum(l == c for l, *_ in rows) + sum(p == c for _, p, _ in rows)))
    assert got["macro_f1"] == pytest.approx(np.mean(f1)) and got["f1_positive"] == pytest.approx(f1[1])


def test_absent_label_counts_as_zero(spark):
    rows = [("a", "a", None), ("b", "b", None)]
    got = measured(spark, rows, ("a", "b", "c"), None)
    assert got["macro_f1"] == pytest.approx(2 / 3) and got["accuracy"] == 1.0 and got["roc_auc"] is None


def test_single_class_has_no_auc(spark):
    got = measured(spark, [("1", "1", 0.9), ("1", "0", 0.2)])
    assert got["roc_auc"] is None and got["f1_positive"] == pytest.approx(2 / 3)


def test_prediction_outside_the_labels_is_just_wrong(spark):
    got = measured(spark, [("a", "z", None), ("a", "a", None)], ("a", "b"), None)
    assert got["n"] == 2 and got["accuracy"] == 0.5 and got["macro_f1"] == pytest.approx((2 / 3) / 2)


def test_groups_are_measured_apart(spark):
    rows = [("g", "1", "1", 0.9), ("g", "0", "0", 0.1), ("h", "1", "0", 0.1), ("h", "0", "1", 0.9)]
    got = m.metrics(spark.createDataFrame(rows, "g string, " + SCHEMA), ["0", "1"], "1", by=["g"]).collect()
    assert {r["g"]: (r["accuracy"], r["roc_auc"]) for r in got} == {"g": (1.0, 1.0), "h": (0.0, 0.0)}


@pytest.mark.parametrize("slices", [None, 16])
def test_running_totals_with_and_without_slices(spark, slices):
    rng = random.Random(5)
    values = sorted(rng.sample(range(10**6), 3000))
    rows = [(v % 2, float(v), rng.randrange(5)) for v in values]
    df = spark.createDataFrame(rows, "g int, v double, n long").repartition(5)
    found = running_totals(df, ["g"], "v", {"n": "before"}, slices, overall={"n": "all"}).collect()
    got = {(r["g"], r["v"]): r["before"] for r in found}
    sums = {0: 0, 1: 0}
    assert {(r["g"], r["all"]) for r in found} == {(g, sum(n for h, _, n in rows if h == g)) for g in (0, 1)}
    for g, v, n in rows:
        assert got[(g, v)] == sums[g]
        sums[g] += n


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_percentiles_against_numpy(spark, n, monkeypatch):
    if n == 1000:  # through slices as well
        monkeypatch.setattr(ordered, "SLICE_ROWS", 10)
    values = np.random.default_rng(n).integers(0, 50, n) / 7
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None)], "g string, v double")
    row = exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, ["g"]).first()
    assert row["p50"] == pytest.approx(np.median(values)) and row["p95"] == pytest.approx(np.percentile(values, 95))


ANSWERS = "g string, error string, latency_s double, input_tokens long"


def test_usage_counts_successes_only(spark):
    rows = [("a", None, 0.1, 10), ("a", None, 0.3, None), ("a", "boom", 9.0, 99), ("b", "boom", None, None), ("c", None, None, None)]
    got = {r["g"]: r for r in m.usage_stats(spark.createDataFrame(rows, ANSWERS), ["g"]).collect()}
    assert (got["a"]["latency_p50_s"], got["a"]["input_tokens_total"]) == (0.2, 10)
    assert "b" not in got and got["c"]["latency_p50_s"] is None and got["c"]["input_tokens_total"] is None


def test_error_summary_shows_three_distinct_messages(spark):
    rows = [("a", e, None, None) for e in ("z", "y", "x", "w", "w", None)]
    got = m.error_summary(spark.createDataFrame(rows, ANSWERS), ["g"]).first()
    assert got["errors"] == 5 and got["error_examples"] == ["w", "x", "y"]


def test_confidence(spark):
    rows = [("a", "x", "x", 0.8), ("a", "x", "y", 0.9), ("a", "x", "y", 0.79), ("b", "x", "x", 0.1), ("c", "x", "x", None)]
    df = spark.createDataFrame(rows, "g string, label string, pred string, confidence double")
    got = {r["g"]: (r["confident_accuracy"], r["confident_share"]) for r in m.confidence_stats(df, ["g"]).collect()}
    assert got == {"a": (0.5, pytest.approx(2 / 3)), "b": (None, 0.0)}
