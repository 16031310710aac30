"""Whole evaluations: split, train, ask, stack, and collect everything in one results table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import report
from evalspark.operators.cluster import ClusterSelection, select_cluster_shots
from evalspark.operators.metrics import confidence_stats, error_summary, metrics, usage_stats
from evalspark.operators.models import evaluate_baseline, oof_scores
from evalspark.operators.requests import DEFAULT_MODEL, build_requests, export_requests, question_json
from evalspark.operators.sampling import require_unique, shots_k, shots_matched, stage2_sample, stratified_split
from evalspark.operators.scoring import Scorer, decode, score_rows
from evalspark.operators.stacking import CONTROL, STACKED, stack
from evalspark.plans.catalog import CATALOG
from evalspark.plans.task import Task
from evalspark.session import new_path, run_folder, stage
from evalspark.sources.results import load_results, save_results

@dataclass
class Examples:
    """Where the examples of a task's questions come from. The clustering is made once, and what a
    variant has picked is written once, since both are used by several runs."""

    task: Task
    train: DataFrame
    _selection: ClusterSelection | None = None
    _picked: dict[str, DataFrame | None] = field(default_factory=dict)
    _asked: dict[str, str] = field(default_factory=dict)

    @property
    def selection(self) -> ClusterSelection:
        if self._selection is None:
            self._selection = select_cluster_shots(self.task, self.train)
        return self._selection

    def rows(self, variant: Variant) -> DataFrame | None:
        """The picked training rows; None where a variant shows none."""
        if variant.name not in self._picked:
            found = variant.pick(self)
            self._picked[variant.name] = found if found is None else stage(found, "shots")
        return self._picked[variant.name]

    def question(self, variant: Variant) -> str:
        if variant.name not in self._asked:
            self._asked[variant.name] = question_json(self.task, self.rows(variant), variant.order)
        return self._asked[variant.name]


@dataclass(frozen=True)
class Variant:
    """A way of showing a judge examples. It knows how to pick its own rows."""

    name: str
    order: str = "row_id"  # the column by which examples are listed

    def pick(self, examples: Examples) -> DataFrame | None:
        raise NotImplementedError


class PerLabel(Variant):
    """As many random rows of each label as the name says; none for "0"."""

    def pick(self, examples: Examples) -> DataFrame | None:
        task, each = examples.task, int(self.name)
        if each == 0:
            return None
        return shots_k(examples.train, list(task.labels), each, task.is_short())


class Representatives(Variant):
    """The row nearest the middle of every cell of label and cluster."""

    def pick(self, examples: Examples) -> DataFrame:
        return examples.selection.shots(examples.train)


class SameNumbers(Variant):
    """Random rows, as many of each label as the representatives have: their control."""

    def pick(self, examples: Examples) -> DataFrame:
        task = examples.task
        return shots_matched(examples.train, examples.rows(REPRESENTATIVES), list(task.labels), task.is_short())


REPRESENTATIVES = Representatives("cluster", order="place")
NAMED_VARIANTS = {v.name: v for v in (REPRESENTATIVES, SameNumbers("cluster-random"))}


def variant_named(name: str) -> Variant:
    return NAMED_VARIANTS[name] if name in NAMED_VARIANTS else PerLabel(name)


STACK_VARIANTS = ("0", "cluster")
# What each argument of an evaluation may hold: names, and whether plain counts will do too.
ARGUMENTS: dict[str, tuple[tuple[str, ...], bool]] = {
    "tasks": (tuple(CATALOG), False),
    "stages": (("baseline", "judge", "stack"), False),
    "variants": (tuple(NAMED_VARIANTS), True),
    "stack_variants": (STACK_VARIANTS, False),
}


def check_arguments(**given: Sequence[str]) -> None:
    """Raise on the first argument that holds something it may not."""
    for argument, values in given.items():
        names, counts = ARGUMENTS[argument]
        for value in values:
            if value not in names and not (counts and value.isdecimal()):
                accepted = ", ".join(names) + (" or a count" if counts else "")
                raise ValueError(f"{value!r} is not accepted in {argument}: {accepted}")


def ask(
    task: Task, rows: DataFrame, question: str, scorer: Scorer, model: str, store: str | None, parallelism: int | None
) -> DataFrame:
    """row_id and the record of every row."""
    return score_rows(build_requests(task, rows, question, model), scorer, store, parallelism)


def _detail_rows(task: Task, method: str, details: DataFrame) -> DataFrame:
    """One row of details per method -> result rows. Numbers become values, anything else text."""
    pairs = []
    for f in details.schema.fields:
        number = f.dataType.typeName() in ("integer", "long", "double")
        value = F.col(f.name).cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else F.col(f.name).cast("string")
        pairs.append(F.struct(F.lit(f.name).alias("metric"), value.alias("value"), text.alias("text")))
    long = details.select(F.inline(F.array(*pairs))).where("value IS NOT NULL OR text IS NOT NULL")
    return long.select(
        F.lit(task.name).alias("task"), F.lit(method).alias("method"), F.lit("details").alias("field"), "metric", "value", "text"
    )


def _setting_rows(spark: SparkSession, task: Task, method: str, field_: str, values: dict) -> DataFrame:
    rows = []
    for metric, v in values.items():
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        rows.append({"task": task.name, "method": method, "field": field_, "metric": metric,
                     "value": float(v) if number else None, "text": None if number or v is None else str(v)})
    return report.result_rows(spark, rows)


def _cell_rows(task: Task, method: str, cells: DataFrame) -> DataFrame:
    """One result row per cell: its size as value, and all that is known of it as text."""
    known = F.to_json(F.struct("label", "cluster", "cell_size", "cluster_size", "label_share", "row_id"))
    return cells.select(
        F.lit(task.name).alias("task"), F.lit(method).alias("method"), F.lit("cells").alias("field"),
        F.concat_ws("/", "label", F.col("cluster").cast("string")).alias("metric"), F.col("cell_size").cast("double").alias("value"),
        known.alias("text"),
    )


def evaluate_variant(
    task: Task, split: DataFrame, variant: Variant, shots: Examples, scorer: Scorer, model: str = DEFAULT_MODEL,
    store: str | None = None, parallelism: int | None = None, previews: str | None = None,
) -> DataFrame:
    """Result rows of one judge variant: scores over the answered rows, and the run's details.

    ``previews`` is a folder that gets the first request of the run as text.
    """
    spark, method = split.sparkSession, report.method_key("judge", variant.name)
    scored = split.where("is_scored")
    question = shots.question(variant)
    if previews is not None:
        export_requests(build_requests(task, scored, question, model), question, f"{previews}/{task.name}-{method}", first=1)
    records = stage(ask(task, scored, question, scorer, model, store, parallelism), "records")
    truth = scored.select("row_id", F.col("label").cast("string").alias("label"))
    pred = decode(task, records).join(truth, "row_id").withColumn("method", F.lit(method))
    answered = pred.where(F.col("error").isNull() & F.col("pred").isNotNull())
    wide = metrics(answered, task.labels, task.positive, by=["method"])
    parts = [report.to_results(wide, F.lit(task.name), F.col("method"), F.lit("metrics"))]

    errors = pred.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    shown = error_summary(pred, ["method"]).select(F.to_json("error_examples").alias("error_examples"))
    parts += [_detail_rows(task, method, d) for d in (errors, shown, usage_stats(pred, ["method"]).drop("method"))]
    if not task.is_binary:
        parts.append(_detail_rows(task, method, confidence_stats(answered, ["method"]).drop("method")))
    settings = {"model": model, "shots": variant.name}
    rows = shots.rows(variant)
    if rows is not None:
        per_label = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
        settings["examples_per_label"] = {r["label"]: r["n"] for r in per_label}
        ids = [r["row_id"] for r in rows.select("row_id").orderBy("row_id").collect()]
        parts.append(_setting_rows(spark, task, method, "shot_rows", {"shot_train_rows": ids}))
    if variant is REPRESENTATIVES:
        chosen = shots.selection
        settings["k"] = chosen.k
        parts.append(_cell_rows(task, method, chosen.cells))
        sil = {f"silhouette_{k}": v for k, v in chosen.silhouettes.items()}
        parts.append(_setting_rows(spark, task, method, "clustering", sil))
    parts.append(_setting_rows(spark, task, method, "details", settings))
    return functools.reduce(DataFrame.unionByName, parts)


def evaluate_stack(
    task: Task, split: DataFrame, variant: Variant, shots: Examples, scorer: Scorer, oof: tuple[DataFrame, bool],
    test_scores: DataFrame, model: str = DEFAULT_MODEL, store: str | None = None, parallelism: int | None = None,
) -> DataFrame:
    """Result rows of the stack of one variant and of its control."""
    spark, method = split.sparkSession, report.method_key("stack", variant.name)
    train, scored = split.where(F.col("split") == "train"), split.where("is_scored")
    sample = stage(stage2_sample(train, shots.rows(variant)), "stage2-sample")
    oof_raw, probabilistic = oof
    # One call for both parts: sample and scored rows share questions and answers.
    asked = sample.unionByName(scored.select(*sample.columns))
    records = stage(ask(task, asked, shots.question(variant), scorer, model, store, parallelism), "records")
    result = stack(task, sample, oof_raw.select("row_id", "raw"), test_scores, probabilistic, records)
    truth = scored.select("row_id", F.col("label").cast("string").alias("label"))
    wide = metrics(result.predictions.join(truth, "row_id"), task.labels, task.positive, by=["method"])
    field_ = F.when(F.col("method") == STACKED, "metrics").when(F.col("method") == CONTROL, "control_metrics")
    info = {"stage2_train_rows": result.train_rows, "judge_missing": result.judge_missing}
    info.update({f"stage2_weight_{k}": v for k, v in (result.weights or {}).items()})
    return report.to_results(wide, F.lit(task.name), F.lit(method), field_).unionByName(
        _setting_rows(spark, task, method, "details", info)
    )


def evaluate_task(
    spark: SparkSession, folder: str, name: str, scorer: Callable[[Task, DataFrame], Scorer], variants: Sequence[str],
    stack_variants: Sequence[str], stages: Sequence[str], scored_n: int | None, model: str, store: str | None,
    parallelism: int | None, previews: str | None,
) -> DataFrame:
    """All result rows of one task."""
    task, rows = CATALOG[name].task, CATALOG[name].load(spark, folder)
    split = stage(stratified_split(rows, scored_n=scored_n), "split")
    require_unique(split)
    train = split.where(F.col("split") == "train")
    shots, judge = Examples(task, train), scorer(task, split)
    described = report.describe(task, split).first()
    sizes = {k: described[k] for k in ("n_scored", "n_test", "n_train")}
    texts = {k: described[k] for k in ("problem", "question_type", "question", "answers", "state_preview", "state_label")}
    parts = [_setting_rows(spark, task, "task", "sizes", sizes), _setting_rows(spark, task, "task", "texts", texts)]
    if "baseline" in stages:
        wide, seconds = evaluate_baseline(task, split)
        parts.append(report.to_results(wide, F.lit(name), F.lit("baseline"), F.col("field")))
        info = {"model": task.baseline_text, "fit_seconds": round(seconds, 2)}
        parts.append(_setting_rows(spark, task, "baseline", "details", info))
    if "judge" in stages:
        for v in variants:
            parts.append(evaluate_variant(task, split, variant_named(v), shots, judge, model, store, parallelism, previews))
    if "stack" in stages:
        oof = oof_scores(task, train)
        test_scores = stage(task.baseline.fit(task, train).score(split.where("is_scored")), "test-scores")
        for v in stack_variants:
            parts.append(evaluate_stack(task, split, variant_named(v), shots, judge, oof, test_scores, model, store, parallelism))
    return functools.reduce(DataFrame.unionByName, parts)


def evaluate(
    spark: SparkSession, folder: str, tasks: Sequence[str], scorer: Callable[[Task, DataFrame], Scorer],
    variants: Sequence[str] = ("0",), stack_variants: Sequence[str] = STACK_VARIANTS,
    stages: Sequence[str] = ARGUMENTS["stages"][0], scored_n: int | None = None, model: str = DEFAULT_MODEL,
    store: str | None = None, parallelism: int | None = None, results: str | None = None, previews: str | None = None,
) -> DataFrame:
    """Run the chosen stages for the chosen tasks; returns the long results table in report order.

    ``scorer`` gives the judge for a task (it also gets the split table, which a test judge may
    use). ``store`` is a folder for the answer tables, one per task. ``results`` is the folder of a results
    table: every task is merged into it as soon as it is done, so a failure costs the running task
    alone. Work tables of a task are removed with it. ``previews`` is a folder for the first request of every run.
    """
    check_arguments(tasks=tasks, variants=variants, stages=stages, stack_variants=stack_variants)
    kept = results or new_path(spark, "results")
    for name in tasks:
        answers = None if store is None else f"{store.rstrip('/')}/{name}"
        with run_folder(spark):
            found = evaluate_task(
                spark, folder, name, scorer, variants, stack_variants, stages, scored_n, model, answers, parallelism, previews
            )
            save_results(found, kept)
    return load_results(spark, kept, tuple(CATALOG))
