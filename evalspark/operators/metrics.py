"""The numbers every method is compared on.

Predictions have ``label`` (truth), ``pred`` and, for binary tasks, ``score`` (P(positive)).
Every function takes ``by``, so many methods are measured in one pass.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.ordered import exact_percentiles, running_totals
from evalspark.functions.scalars import round_binary

# When an answer counts as confident; how many error texts are shown.
CONFIDENT = 0.8
ERROR_EXAMPLES = 3


def label_scores(pred: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group and label: true positives, true rows, predicted rows and F1 (0 where undefined)."""
    pairs = pred.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("of"), F.col("n").alias("truth"), zero.alias("guessed"), hit.alias("tp")),
        F.struct(F.col("pred").alias("of"), zero.alias("truth"), F.col("n").alias("guessed"), zero.alias("tp")),
    )
    per_label = pairs.select(*by, F.inline(sides)).groupBy(*by, "of").agg(
        *[F.sum(c).alias(c) for c in ("truth", "guessed", "tp")]
    )
    f1 = F.when(F.col("of").isin(list(labels)), _f1(F.col("tp"), F.col("truth") + F.col("guessed")))
    return per_label.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def roc_auc(pred: DataFrame, positive: str, by: Sequence[str]) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half; null when only one class occurs."""
    is_pos = (F.col("label") == positive).cast("long")
    points = pred.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")
    )
    ranked = running_totals(points, by, "score", {"neg": "neg_below"})
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("roc_auc"))


def _f1(tp: Column, both: Column) -> Column:
    return F.when(both > 0, 2.0 * tp / both).otherwise(F.lit(0.0))


def _binary_metrics(pred: DataFrame, labels: Sequence[str], positive: str, by: Sequence[str]) -> DataFrame:
    """All counts are taken per score in the one aggregation the AUC needs, and added up after it."""
    label, guess, known = F.col("label"), F.col("pred"), F.col("score").isNotNull()
    counts = {
        "n": F.count("*"), "hits": F.count_if(label == guess),
        "auc_pos": F.count_if(known & (label == positive)), "auc_neg": F.count_if(known & (label != positive)),
    }
    for i, l in enumerate(labels):
        counts[f"tp_{i}"] = F.count_if((label == l) & (guess == l))
        counts[f"both_{i}"] = F.count_if(label == l) + F.count_if(guess == l)
    # A row without a score takes part in the counts, and has no part in the AUC.
    placed = pred.withColumn("_score", F.coalesce("score", F.lit(float("-inf"))))
    points = placed.groupBy(*by, "_score").agg(*[c.alias(name) for name, c in counts.items()])
    won = F.col("auc_pos").cast("double") * (F.col("neg_below") + F.col("auc_neg") / 2.0)
    sums = running_totals(points, by, "_score", {"auc_neg": "neg_below"}).groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in counts], F.sum(won).alias("won")
    )
    f1 = [_f1(F.col(f"tp_{i}"), F.col(f"both_{i}")) for i in range(len(labels))]
    pairs = F.col("auc_pos").cast("double") * F.col("auc_neg")
    return sums.select(
        *by, "n", (F.col("hits") / F.col("n")).alias("accuracy"), (sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"),
        f1[list(labels).index(positive)].alias("f1_positive"), F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"),
    )


def metrics(pred: DataFrame, labels: Sequence[str], positive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and macro-F1 over the full label list; with ``positive`` also its F1 and ROC AUC."""
    by = list(by)
    if positive is not None:
        return _binary_metrics(pred, labels, positive, by)
    none = F.lit(None).cast("double")
    summary = label_scores(pred, labels, by).groupBy(*by).agg(
        F.sum("truth").alias("n"), (F.sum("tp") / F.sum("truth")).alias("accuracy"),
        (F.sum("f1") / len(labels)).alias("macro_f1"),
    )
    return summary.withColumns({"f1_positive": none, "roc_auc": none})


def label_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "label").agg(F.count("*").alias("n")).orderBy(*by, "label")


def _merged(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Columns of several one-row-per-group tables side by side: laid together and merged, without a join."""
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(*by).agg(*[F.any_value(c, True).alias(c) for c in both.columns if c not in by])


def usage_stats(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Latency percentiles and token total of the successful answers; null where none is recorded."""
    by = list(by)
    good = answers.where(F.col("error").isNull())
    spread = exact_percentiles(good, "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95}, by)
    tokens = good.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens_total"))
    return _merged(by, tokens, spread).select(
        *by, *[round_binary(F.col(c), 3).alias(c) for c in ("latency_p50_s", "latency_p95_s")], "input_tokens_total"
    )


def confidence_stats(pred: DataFrame, by: Sequence[str], threshold: float = CONFIDENT) -> DataFrame:
    """How many answers are confident, and how accurate those are (null when none is)."""
    sure = F.col("confidence") >= threshold
    right = (F.col("label") == F.col("pred")).cast("double")
    return pred.where(F.col("confidence").isNotNull()).groupBy(*by).agg(
        F.avg(F.when(sure, right)).alias("confident_accuracy"), F.avg(sure.cast("double")).alias("confident_share")
    )


def error_summary(answers: DataFrame, by: Sequence[str], examples: int = ERROR_EXAMPLES) -> DataFrame:
    """Failures per group, and the first few of the sorted distinct messages."""
    by = list(by)
    messages = answers.where(F.col("error").isNotNull()).groupBy(*by, "error").agg(F.count("*").alias("n"))
    totals = messages.groupBy(*by).agg(F.sum("n").alias("errors"))
    first = messages.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("error")))
    shown = first.where(F.col("_place") <= examples).groupBy(*by).agg(
        F.sort_array(F.collect_list("error")).alias("error_examples")
    )
    return _merged(by, totals, shown)
