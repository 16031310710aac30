"""Result tables: method registry, leaderboards, run details, overview, contribution.

Results are one long table: task, method, field, metric, value, text. Scores sit under the fields
"metrics", "full_test_metrics" and "control_metrics"; sizes and texts of a task under the method
"task"; settings and costs of a method under the field "details". It holds a few numbers per task
and method, whatever the size of the data they were measured on.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.scalars import round_binary
from evalspark.functions.state import state_json
from evalspark.functions.text import truncate
from evalspark.operators.sampling import local_table
from evalspark.plans.task import Task
from evalspark.session import stage

RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("task", "method", "field", "metric")]
    + [T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType())]
)
_ARROW = pa.schema([(n, pa.string()) for n in ("task", "method", "field", "metric")] + [("value", pa.float64()), ("text", pa.string())])

# Metric names, printed precision and the preview length of a state.
METRICS = ("n", "accuracy", "macro_f1", "f1_positive", "roc_auc")
PRECISION = 3
PREVIEW = 110
KEY = ["task", "method"]


def result_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Driver-made result rows (settings, sizes, times)."""
    return local_table(spark, rows, _ARROW)


def to_results(wide: DataFrame, task: Column, method: Column, field: Column) -> DataFrame:
    """Metric columns of one row per method become result rows; absent metrics are left out."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS if m in wide.columns]
    long = wide.select(task.alias("task"), method.alias("method"), field.alias("field"), F.inline(F.array(*pairs)))
    return long.where(F.col("value").isNotNull()).withColumn("text", F.lit(None).cast("string"))


# ---------------------------------------------------------------- the method registry


# The keys under which runs are kept, by kind of run and variant; runs with a number of
# examples per label follow the pattern.
METHOD_KEYS = {
    ("judge", "0"): "judge",
    ("judge", "cluster"): "judge_cluster",
    ("judge", "cluster-random"): "judge_cluster_random",
    ("stack", "0"): "stack",
    ("stack", "cluster"): "stack_cluster",
}
COUNTED_KEY = "judge_{}shot"


def method_key(kind: str, variant: str) -> str:
    known = METHOD_KEYS.get((kind, variant))
    if known is None and kind == "judge":
        known = COUNTED_KEY.format(int(variant))
    if known is None:
        raise ValueError(f"no {kind} run of variant {variant}")
    return known


def with_method_names(df: DataFrame) -> DataFrame:
    """Add ``label`` and ``ordinal`` to rows with ``method`` and ``field``; report order is by ordinal.

    Order: the baseline, k-shot by k, the cluster variants, then each stack after its control.
    """
    method, control = F.col("method"), F.col("field") == "control_metrics"
    shots = F.regexp_extract(method, r"^judge_(\d+)shot$", 1)
    k = F.when(shots != "", shots.cast("int"))
    stacked = F.regexp_replace(F.regexp_replace(method, "^stack_?", ""), "_", "-")
    variant = F.when(stacked == "", F.lit("0-shot")).otherwise(stacked)
    label = (
        F.when(method == "baseline", F.lit("Baseline")).when(method == "judge", F.lit("Judge 0-shot"))
        .when(k.isNotNull(), F.concat(F.lit("Judge "), shots, F.lit("-shot")))
        .when(method == "judge_cluster", F.lit("Judge cluster-shot"))
        .when(method == "judge_cluster_random", F.lit("Judge matched random"))
        .when(control, F.concat(F.lit("Stage 2, baseline only ("), variant, F.lit(")")))
        .when(method.startswith("stack"), F.concat(F.lit("Baseline + judge "), variant))
    )
    step = F.when(control, F.lit(0)).otherwise(F.lit(1))
    ordinal = (
        F.when(method == "baseline", F.lit(0)).when(method == "judge", F.lit(1_000))
        .when(k.isNotNull(), 1_000 + k).when(method == "judge_cluster", F.lit(1_000_000))
        .when(method == "judge_cluster_random", F.lit(1_000_001)).when(method == "stack", 2_000_000 + step)
        .when(method.startswith("stack"), 2_000_010 + step)
    )
    return df.withColumn("label", label).withColumn("ordinal", ordinal)


def method_dim(results: DataFrame) -> DataFrame:
    """Every method present in the results, named and in report order."""
    scored = results.where(F.col("field").isin("metrics", "control_metrics")).select("method", "field").distinct()
    return with_method_names(scored).where(F.col("ordinal").isNotNull()).orderBy("ordinal")


# ---------------------------------------------------------------- tables


def upsert_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """What ``new`` says of a run takes the place of all that was known of that run."""
    return old.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new)


def in_report_order(results: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Results sorted by the given order of tasks (others after them, by name), then by method."""
    place = F.lit(len(tasks))
    for i, name in enumerate(tasks):
        place = F.when(F.col("task") == name, F.lit(i)).otherwise(place)
    named = with_method_names(results).withColumn("_place", place)
    return named.orderBy("_place", "task", F.asc_nulls_first("ordinal"), "method", "field", "metric").drop("_place", "label", "ordinal")


def uses_subset(results: DataFrame) -> DataFrame:
    """One row: whether any task was scored on a part of its test split."""
    sizes = results.where(F.col("field") == "sizes").groupBy("task").agg(
        F.max(F.when(F.col("metric") == "n_scored", F.col("value"))).alias("n_scored"),
        F.max(F.when(F.col("metric") == "n_test", F.col("value"))).alias("n_test"),
    )
    return sizes.agg(F.coalesce(F.bool_or(F.col("n_scored") < F.col("n_test")), F.lit(False)).alias("uses_subset"))


def leaderboard(results: DataFrame, metric: str) -> DataFrame:
    """Tasks with a baseline value of the metric, crossed with all methods of the results.

    ``value`` is null for combinations that were not run. ``is_best`` compares values as they are printed,
    so a task can have several best methods.
    """
    results = stage(results, "leaderboard-input")  # a few rows per method, read several times below
    scores = results.where(
        (F.col("metric") == metric) & F.col("field").isin("metrics", "control_metrics")
    ).select("task", "method", "field", "value")
    names = method_dim(results)
    listed = names.agg(F.collect_list(F.struct("method", "field", "label", "ordinal")).alias("methods")).scalar()
    tasks = scores.where((F.col("method") == "baseline") & (F.col("field") == "metrics")).select("task")
    grid = tasks.withColumn("_methods", listed).select("task", F.inline("_methods"))
    filled = grid.join(scores, ["task", "method", "field"], "left")
    shown = round_binary(F.col("value"), PRECISION)
    best = F.max(shown).over(Window.partitionBy("task"))
    return filled.withColumn("is_best", F.coalesce(shown == best, F.lit(False))).select(
        "task", "ordinal", "method", "field", "label", "value", "is_best"
    )


def leaderboard_wide(results: DataFrame, metric: str, full_test: bool = False) -> DataFrame:
    """The leaderboard with one column per method, and the labels of the best as a list.

    ``full_test`` adds the baseline's value on the whole test split, for runs scored on a subset.
    """
    results = stage(results, "leaderboard-input")
    long = stage(leaderboard(results, metric), "leaderboard")
    order = [r["label"] for r in long.select("label", "ordinal").distinct().orderBy("ordinal").collect()]
    wide = long.groupBy("task").pivot("label", order).agg(F.first("value"))
    best = long.where("is_best").groupBy("task").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "label"))), lambda b: b["label"]).alias("best")
    )
    sizes = results.where((F.col("field") == "sizes") & (F.col("metric") == "n_scored")).select(
        "task", F.col("value").cast("long").alias("n")
    )
    out = sizes.join(wide, "task").join(best, "task")
    if full_test:
        whole = results.where(
            (F.col("method") == "baseline") & (F.col("field") == "full_test_metrics") & (F.col("metric") == metric)
        ).select("task", F.col("value").alias("Baseline full test"))
        out = out.join(whole, "task", "left")
    return out


def run_details(results: DataFrame) -> DataFrame:
    """task, method, label, details: settings and costs of every run as a map, without long fields."""
    details = results.where(F.col("field") == "details").select(
        "task", "method", F.lit("metrics").alias("field"), "metric", F.coalesce("text", F.col("value").cast("string")).alias("shown")
    )
    named = with_method_names(details).where(F.col("shown").isNotNull())
    pairs = F.sort_array(F.collect_list(F.struct("metric", "shown")))
    return named.groupBy("task", "method", "label", "ordinal").agg(F.map_from_entries(pairs).alias("details"))


def contribution(results: DataFrame, metric: str) -> DataFrame:
    """Per task and stack: what the judge adds over the control, whether the stack beats both
    sources alone, and what the re-fit alone changes."""
    scores = results.where(F.col("metric") == metric).select("task", "method", "field", "value")

    def of(method: str, field: str, name: str) -> DataFrame:
        return scores.where((F.col("method") == method) & (F.col("field") == field)).select("task", F.col("value").alias(name))

    stacks = scores.where(F.col("method").startswith("stack") & (F.col("field") == "metrics")).select(
        "task", "method", F.col("value").alias("stacked")
    )
    controls = scores.where(F.col("field") == "control_metrics").select("task", "method", F.col("value").alias("control"))
    joined = stacks.join(controls, KEY).join(of("baseline", "metrics", "baseline"), "task").join(
        of("judge", "metrics", "judge"), "task", "left"
    )
    single = F.greatest("baseline", "judge")
    return joined.select(
        "task", "method", "stacked", "control", (F.col("stacked") - F.col("control")).alias("judge_adds"),
        (F.col("stacked") - single).alias("over_best_single"), (F.col("control") - F.col("baseline")).alias("refit_adds"),
    )


def describe(task: Task, split: DataFrame) -> DataFrame:
    """One row: sizes, question, and the first scored state (cut to a preview) with its label."""
    answers = "yes / no" if task.is_binary else " / ".join(task.criteria)
    sizes = split.agg(
        F.count_if("is_scored").alias("n_scored"), F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if(F.col("split") == "train").alias("n_train"),
    )
    # Only the first row becomes a state.
    preview = truncate(state_json(task.state()), PREVIEW)
    first = split.where("is_scored").orderBy("row_id").limit(1).select(
        F.struct(preview.alias("state_preview"), F.col("label").cast("string").alias("state_label"))
    )
    return sizes.withColumn("_first", first.scalar()).select(
        F.lit(task.name).alias("task"), "n_scored", "n_test", "n_train", F.lit(task.problem).alias("problem"),
        F.lit("Binary" if task.is_binary else "Choice").alias("question_type"),
        F.lit(task.instructions).alias("question"), F.lit(answers).alias("answers"), "_first.state_preview", "_first.state_label",
    )


def overview(descriptions: Sequence[DataFrame]) -> DataFrame:
    """The overview table: one described row per task."""
    out = descriptions[0]
    for d in descriptions[1:]:
        out = out.unionByName(d)
    return out
