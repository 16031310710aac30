from __future__ import annotations

import ast
import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import report
from evalspark.operators.models import TableBoosting
from evalspark.operators.sampling import stratified_split
from evalspark.operators.scoring import ColumnScorer
from evalspark.plans import catalog
from evalspark.plans.evaluate import Examples, check_arguments, evaluate, variant_named
from evalspark.session import new_path
from evalspark.sources import answers
from evalspark.sources.answers import as_records
from evalspark.sources.results import load_results, save_results


class TruthJudge:
    """Always right: looks the label of a state up in the split table."""

    def __init__(self, task, split):
        self.task = task
        self.truth = split.select(task.state_json().alias("state_json"), "label").groupBy("state_json").agg(F.max("label").alias("label"))

    def score(self, requests):
        known = requests.join(self.truth, "state_json")
        used = [F.lit(0.2).alias("latency_s"), F.lit(1).alias("input_tokens")]
        if self.task.is_binary:
            p = F.when(F.col("label") == self.task.positive, 0.9).otherwise(0.1)
            return as_records(known.select("request_key", p.alias("p_yes"), *used))
        pairs = [x for l in self.task.labels for x in (F.lit(l), (F.col("label") == l).cast("double"))]
        return as_records(known.select(
            "request_key", F.col("label").alias("choice"), F.lit(1.0).alias("confidence"),
            F.create_map(*pairs).alias("probabilities"), *used,
        ))


@pytest.fixture(scope="module")
def results(spark, public_files):
    # Fewer trees than the task's own, to keep the run short.
    full = catalog.CATALOG["titanic"]
    small = dataclasses.replace(full.task, baseline=TableBoosting(iterations=8, depth=3))
    catalog.CATALOG["titanic"] = dataclasses.replace(full, task=small)
    yield _results(spark, public_files)
    catalog.CATALOG["titanic"] = full


def _results(spark, public_files):
    return evaluate(spark, public_files, ["iris", "titanic"], TruthJudge, ["0", "cluster", "cluster-random"],
                    store=new_path(spark, "store")).cache()


def value(results, task, method, metric, field="metrics"):
    rows = results.where(f"task = '{task}' AND method = '{method}' AND metric = '{metric}' AND field = '{field}'").collect()
    assert len(rows) == 1
    return rows[0]["text"] if rows[0]["value"] is None else rows[0]["value"]


def test_a_judge_that_is_right_scores_one(results):
    assert value(results, "iris", "judge", "accuracy") == 1.0
    assert value(results, "titanic", "judge", "roc_auc") == 1.0
    assert value(results, "iris", "judge_cluster", "accuracy") == 1.0


@pytest.mark.parametrize("task", ["iris", "titanic"])
@pytest.mark.parametrize("method", ["stack", "stack_cluster"])
def test_stack_is_no_worse_than_its_control(results, task, method):
    assert value(results, task, method, "accuracy") >= value(results, task, method, "accuracy", "control_metrics")


def test_sizes_and_details(results):
    assert [value(results, "titanic", "task", m, "sizes") for m in ("n_train", "n_test", "n_scored")] == [712, 179, 179]
    assert value(results, "iris", "baseline", "accuracy") > 0.8
    assert value(results, "iris", "judge", "input_tokens_total", "details") == 30
    assert value(results, "iris", "judge", "confident_share", "details") == 1.0
    assert value(results, "titanic", "stack", "stage2_train_rows", "details") == 712
    assert value(results, "titanic", "stack", "stage2_weight_judge", "details") > 0
    cluster = value(results, "iris", "judge_cluster", "examples_per_label", "details")
    assert cluster == value(results, "iris", "judge_cluster_random", "examples_per_label", "details")
    n_shots = sum(ast.literal_eval(cluster).values())
    assert value(results, "iris", "stack_cluster", "stage2_train_rows", "details") == 120 - n_shots


def test_report_tables(results):
    board = report.leaderboard_wide(results, "accuracy")
    for column in ("Baseline", "Judge 0-shot", "Judge cluster-shot", "Judge matched random", "Baseline + judge 0-shot",
                   "Stage 2, baseline only (0-shot)", "Stage 2, baseline only (cluster)"):
        assert column in board.columns
    assert {r["task"]: r["n"] for r in board.collect()} == {"iris": 30, "titanic": 179}
    assert "Judge 0-shot" in board.where("task = 'iris'").first()["best"]
    assert [r["task"] for r in report.leaderboard_wide(results, "roc_auc").collect()] == ["titanic"]
    assert not report.uses_subset(results).first()["uses_subset"]
    details = {r["method"]: r["details"] for r in report.run_details(results).where("task = 'iris'").collect()}
    assert details["judge"]["latency_p50_s"] == "0.2" and "shot_train_rows" not in details["judge_cluster"]
    added = {(r["task"], r["method"]): r for r in report.contribution(results, "accuracy").collect()}
    assert set(added) == {(t, m) for t in ("iris", "titanic") for m in ("stack", "stack_cluster")}
    assert all(r["judge_adds"] >= 0 for r in added.values())


def test_scored_subset_shows_the_full_test_too(spark, public_files):
    out = evaluate(spark, public_files, ["iris"], TruthJudge, stages=["baseline"], scored_n=12)
    assert value(out, "iris", "baseline", "n") == 12 and value(out, "iris", "baseline", "n", "full_test_metrics") == 30
    assert report.uses_subset(out).first()["uses_subset"]
    assert "Baseline full test" in report.leaderboard_wide(out, "accuracy", full_test=True).columns


def test_failed_answers_leave_fewer_rows(spark, public_files):
    def half(task, split):
        error = F.when(F.col("state_json").contains('"sepal_length":5'), F.lit("down"))
        p = F.create_map(*[x for l in task.labels for x in (F.lit(l), F.lit(1 / 3))])
        return ColumnScorer(choice=F.lit("setosa"), confidence=F.lit(0.5), probabilities=p, error=error)

    store = new_path(spark, "half")
    out = evaluate(spark, public_files, ["iris"], half, stages=["judge"], store=store)
    failed = value(out, "iris", "judge", "errors", "details")
    assert 0 < failed < 30 and value(out, "iris", "judge", "n") == 30 - failed
    assert value(out, "iris", "judge", "error_examples", "details") == '["down"]'
    assert answers.read_answers(spark, f"{store}/iris").count() == 30 - failed

    none = evaluate(spark, public_files, ["iris"], lambda t, s: ColumnScorer(error=F.lit("down")), stages=["judge"])
    assert none.where("field = 'metrics'").count() == 0 and value(none, "iris", "judge", "errors", "details") == 30


def test_saved_results_are_replaced_method_by_method(spark):
    path = new_path(spark, "saved")
    assert load_results(spark, path).count() == 0

    def entry(method, metric, v):
        return {"task": "t", "method": method, "field": "metrics", "metric": metric, "value": v, "text": None}

    save_results(report.result_rows(spark, [entry("a", "x", 1.0), entry("a", "y", 2.0), entry("b", "x", 3.0)]), path)
    assert save_results(report.result_rows(spark, [entry("a", "x", 9.0)]), path) == 1
    got = {(r["method"], r["metric"]): r["value"] for r in load_results(spark, path).collect()}
    assert got == {("a", "x"): 9.0, ("b", "x"): 3.0}


@pytest.mark.parametrize("bad", [dict(tasks=["nope"]), dict(variants=["x"]), dict(variants=["-1"]), dict(stages=["report"]), dict(stack_variants=["3"])])
def test_unknown_names_are_rejected(bad):
    good = dict(tasks=["iris"], variants=["0", "12", "cluster"], stages=["judge"], stack_variants=["0"])
    check_arguments(**good)
    with pytest.raises(ValueError):
        check_arguments(**{**good, **bad})


def test_shots_come_from_train_and_never_from_stage2(spark, public_files):
    task = catalog.IRIS
    split = stratified_split(catalog.CATALOG["iris"].load(spark, public_files)).cache()
    train = split.where("split = 'train'")
    shots = Examples(task, train)
    for variant in ("3", "cluster", "cluster-random"):
        rows = shots.rows(variant_named(variant))
        assert rows.join(train, "row_id", "left_semi").count() == rows.count()
        assert {r["label"] for r in rows.select("label").distinct().collect()} == set(task.labels)
    assert shots.rows(variant_named("0")) is None and shots.rows(variant_named("3")).count() == 9
    criteria = json.loads(shots.question(variant_named("3")))["criteria"]
    assert all(len(c["examples"]) == 3 for c in criteria.values())
    assert shots.selection.k >= 3
    count = lambda v: sorted((r["label"], r["count"]) for r in shots.rows(variant_named(v)).groupBy("label").count().collect())
    assert count("cluster") == count("cluster-random")


def test_public_files_load(spark, public_files):
    sizes = {"titanic": 891, "sms_spam": 153, "imdb": 80, "bbc_news": 100, "iris": 150}
    for name, n in sizes.items():
        task, rows = catalog.CATALOG[name].task, catalog.CATALOG[name].load(spark, public_files).cache()
        assert rows.count() == n and rows.select("row_id").distinct().count() == n
        assert {r["label"] for r in rows.select("label").distinct().collect()} <= set(task.labels)
        assert rows.select(task.state_json()).count() == n
    imdb = catalog.CATALOG["imdb"].load(spark, public_files)
    assert imdb.where("text LIKE '%<br%'").count() == 0 and imdb.where("text LIKE 'A fine film 3, truly \"great\".\nSee it.'").count() == 0
    assert imdb.where("text = 'A fine film 3,  truly \"great\".\nSee it.'").count() == 1
    sms = catalog.CATALOG["sms_spam"].load(spark, public_files)
    assert sms.where("text = '\"unclosed quote'").count() == 1 and sms.where("text = 'ok'").count() == 2


def test_names_are_not_shown_to_a_judge(spark, public_files):
    rows = catalog.CATALOG["titanic"].load(spark, public_files)
    assert rows.select(catalog.TITANIC.state_json().alias("s")).where("s LIKE '%Person%'").count() == 0


def test_passenger_state(spark, public_files):
    row = catalog.CATALOG["titanic"].load(spark, public_files).where("Age IS NULL AND Cabin IS NULL")
    state = json.loads(row.select(catalog.TITANIC.state_json()).first()[0])["passenger"]
    assert list(state) == ["ticket_class", "sex", "title", "age_years", "siblings_or_spouses_aboard", "parents_or_children_aboard",
                           "fare_paid_gbp", "has_recorded_cabin", "port_of_embarkation"]
    assert state["age_years"] is None and state["has_recorded_cabin"] is False


def test_many_equal_rows_get_their_own_ids(spark, monkeypatch):
    from evalspark.sources import tables

    monkeypatch.setattr(tables, "COPIES", 7)
    df = spark.createDataFrame([("same", None)] * 100 + [("other", "x")], "a string, b string")
    got = tables.with_row_id(df)
    assert got.count() == 101 and got.select("row_id").distinct().count() == 101
    again = {r["row_id"] for r in tables.with_row_id(df.repartition(9)).collect()}
    assert again == {r["row_id"] for r in got.collect()}
