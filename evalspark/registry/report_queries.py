"""Result tables, leaderboards, stacking and whole evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import models, report, sampling
from evalspark.operators.metrics import metrics
from evalspark.operators.stacking import stack as stack_models
from evalspark.operators.requests import build_requests, export_requests
from evalspark.operators.scoring import score_rows
from evalspark.plans import catalog, evaluate
from evalspark.plans.catalog import DOC_LANG, DOC_QUALITY, ORDER_STATUS
from evalspark.registry import judges, sql
from evalspark.registry.base import query
from evalspark.registry.column_queries import LANG_STATE, ORDER_STATE
from evalspark.registry.scoring_queries import rounded
from evalspark.session import new_path, stage
from evalspark.sources import tables
from evalspark.sources.results import load_results, save_results

# Rules on lineitem columns stand for methods, the return flags for tasks.
RULES = {
    ("baseline", "metrics"): "l_quantity > 25",
    ("judge", "metrics"): "l_discount > 0.05",
    ("judge_3shot", "metrics"): "l_tax > 0.04",
    ("judge_cluster", "metrics"): "l_linenumber > 3",
    ("stack", "metrics"): "l_quantity > 25 AND l_discount > 0.02",
    ("stack", "control_metrics"): "l_quantity > 20",
    ("stack_cluster", "metrics"): "l_quantity > 25 OR l_discount > 0.07",
    ("stack_cluster", "control_metrics"): "l_quantity > 30",
}


def rule_results(spark, folder):
    """Accuracy, macro-F1 and F1 of every rule for each return flag, as long results: one pass over lineitem."""
    rows = tables.load(spark, folder, "lineitem")
    guesses = [
        F.struct(F.lit(m).alias("method"), F.lit(f).alias("field"), F.when(F.expr(rule), "F").otherwise("O").alias("pred"))
        for (m, f), rule in RULES.items()
    ]
    pred = rows.select(
        F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("label"), F.inline(F.array(*guesses))
    ).withColumn("score", F.lit(None).cast("double"))
    wide = metrics(pred, ["F", "O"], "F", by=["task", "method", "field"]).drop("roc_auc")
    scores = report.to_results(wide, F.col("task"), F.col("method"), F.col("field"))
    sizes = rows.groupBy(F.col("l_returnflag").alias("task")).agg(F.count("*").alias("n")).select(
        "task", F.lit("task").alias("method"), F.lit("sizes").alias("field"), F.lit("n_scored").alias("metric"),
        F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("text"),
    )
    return stage(scores.unionByName(sizes), "rule-results")


def _rules_sql() -> str:
    parts = []
    for (m, f), rule in RULES.items():
        guess = f"(SELECT l_returnflag AS task, l_linestatus AS label, CASE WHEN {rule} THEN 'F' ELSE 'O' END AS pred FROM lineitem)"
        f1 = {
            l: f"2.0 * count(*) FILTER (WHERE label = '{l}' AND pred = '{l}') / "
            f"nullif(count(*) FILTER (WHERE label = '{l}') + count(*) FILTER (WHERE pred = '{l}'), 0)"
            for l in ("F", "O")
        }
        parts.append(
            f"SELECT task, '{m}' AS method, '{f}' AS field, CAST(count(*) AS DOUBLE) AS n, avg(CAST(label = pred AS INTEGER)) AS accuracy, "
            f"(coalesce({f1['F']}, 0) + coalesce({f1['O']}, 0)) / 2 AS macro_f1, coalesce({f1['F']}, 0) AS f1_positive FROM {guess} GROUP BY task"
        )
    wide = " UNION ALL ".join(parts)
    return f"""rule_wide AS ({wide}),
results AS (SELECT task, method, field, metric, value, NULL::VARCHAR AS text FROM
  (UNPIVOT rule_wide ON n, accuracy, macro_f1, f1_positive INTO NAME metric VALUE value)
  UNION ALL SELECT l_returnflag, 'task', 'sizes', 'n_scored', CAST(count(*) AS DOUBLE), NULL FROM lineitem GROUP BY 1)"""


RESULTS = _rules_sql()
KEYS_IN_ORDER = [
    ("judge", "metrics", "Judge 0-shot", 1_000), ("judge_3shot", "metrics", "Judge 3-shot", 1_003),
    ("judge_cluster", "metrics", "Judge cluster-shot", 1_000_000),
    ("stack", "control_metrics", "Stage 2, baseline only (0-shot)", 2_000_000),
    ("stack", "metrics", "Baseline + judge 0-shot", 2_000_001),
    ("stack_cluster", "control_metrics", "Stage 2, baseline only (cluster)", 2_000_010),
    ("stack_cluster", "metrics", "Baseline + judge cluster", 2_000_011),
]
NAMES = "(VALUES ('baseline', 'metrics', 'Baseline', 0), " + ", ".join(str(k) for k in KEYS_IN_ORDER) + ") AS names(method, field, label, ordinal)"


@query("rule_results", f"WITH {RESULTS} SELECT task, method, field, metric, round(value, 6) AS value FROM results")
def rule_results_query(spark, folder):
    return rounded(rule_results(spark, folder).drop("text"))


@query("method_dim", f"SELECT method, field, label, CAST(ordinal AS INTEGER) AS ordinal FROM {NAMES}")
def method_dim(spark, folder):
    return report.method_dim(rule_results(spark, folder))


@query(
    "results_upsert",
    f"""WITH {RESULTS}, fresh AS (SELECT task, method, field, metric, value + 1 AS value FROM results WHERE method = 'stack' AND metric = 'accuracy')
SELECT task, method, field, metric, round(value, 6) AS value FROM results WHERE method <> 'stack'
UNION ALL SELECT task, method, field, metric, round(value, 6) FROM fresh""",
)
def results_upsert(spark, folder):
    """Two saves: the second replaces the entries of one method and keeps all others."""
    path, results = new_path(spark, "result-versions"), rule_results(spark, folder)
    save_results(results, path)
    fresh = results.where("method = 'stack' AND metric = 'accuracy'").withColumn("value", F.col("value") + 1)
    save_results(fresh, path)
    return rounded(load_results(spark, path).drop("text"))


@query(
    "leaderboard",
    f"""WITH {RESULTS}, grid AS (SELECT t.task, names.* FROM (SELECT DISTINCT task FROM results) t, {NAMES}),
filled AS (SELECT grid.*, value FROM grid LEFT JOIN (SELECT * FROM results WHERE metric = 'accuracy') USING (task, method, field))
SELECT task, CAST(ordinal AS INTEGER) AS ordinal, label, round(value, 6) AS value,
  round(value, 3) = max(round(value, 3)) OVER (PARTITION BY task) AS is_best FROM filled""",
)
def leaderboard(spark, folder):
    board = report.leaderboard(rule_results(spark, folder), "accuracy")
    return rounded(board.select("task", "ordinal", "label", "value", "is_best"))


def _wide_sql() -> str:
    labels = ["Baseline"] + [k[2] for k in KEYS_IN_ORDER]
    columns = ", ".join(f"round(max(value) FILTER (WHERE label = '{l}'), 6) AS \"{l}\"" for l in labels)
    return f"""WITH {RESULTS}, named AS (SELECT task, label, ordinal, value FROM results JOIN {NAMES} USING (method, field) WHERE metric = 'macro_f1'),
best AS (SELECT *, round(value, 3) = max(round(value, 3)) OVER (PARTITION BY task) AS top FROM named),
sizes AS (SELECT task, CAST(value AS BIGINT) AS n FROM results WHERE field = 'sizes')
SELECT task, any_value(n) AS n, {columns}, string_agg(label, ' | ' ORDER BY ordinal) FILTER (WHERE top) AS best FROM best JOIN sizes USING (task) GROUP BY task"""


@query("leaderboard_wide", _wide_sql())
def leaderboard_wide(spark, folder):
    board = report.leaderboard_wide(rule_results(spark, folder), "macro_f1")
    return rounded(board.withColumn("best", F.array_join("best", " | ")))


@query(
    "contribution",
    f"""WITH {RESULTS}, a AS (SELECT * FROM results WHERE metric = 'accuracy'),
s AS (SELECT task, method, value AS stacked FROM a WHERE method LIKE 'stack%' AND field = 'metrics'),
c AS (SELECT task, method, value AS control FROM a WHERE field = 'control_metrics'),
b AS (SELECT task, value AS baseline FROM a WHERE method = 'baseline'), j AS (SELECT task, value AS judge FROM a WHERE method = 'judge')
SELECT task, method, round(stacked, 6) AS stacked, round(control, 6) AS control, round(stacked - control, 6) AS judge_adds,
  round(stacked - greatest(baseline, judge), 6) AS over_best_single, round(control - baseline, 6) AS refit_adds
FROM s JOIN c USING (task, method) JOIN b USING (task) JOIN j USING (task)""",
)
def contribution(spark, folder):
    return rounded(report.contribution(rule_results(spark, folder), "accuracy"))


@query(
    "run_details",
    """SELECT l_returnflag AS task, 'judge' AS method, 'Judge 0-shot' AS label,
'model=' || max(l_linestatus) || ', rows=' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS details FROM lineitem GROUP BY 1""",
)
def run_details(spark, folder):
    """Details of one method per task, with a long field that stays out of the report."""
    grouped = tables.load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(
        F.count("*").cast("double").alias("n"), F.max("l_linestatus").alias("model")
    )
    empty_text, empty_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    entries = F.array(
        F.struct(F.lit("details").alias("field"), F.lit("rows").alias("metric"), F.col("n").alias("value"), empty_text.alias("text")),
        F.struct(F.lit("details").alias("field"), F.lit("model").alias("metric"), empty_value.alias("value"), F.col("model").alias("text")),
        F.struct(F.lit("shot_rows").alias("field"), F.lit("shot_train_rows").alias("metric"), empty_value.alias("value"), F.lit("[1, 2]").alias("text")),
    )
    results = grouped.select("task", F.lit("judge").alias("method"), F.inline(entries))
    pairs = F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return report.run_details(results).select("task", "method", "label", F.array_join(pairs, ", ").alias("details"))


def _overview_sql(task, source: str, state: str) -> str:
    answers = "yes / no" if task.is_binary else " / ".join(task.criteria)
    first = f"CAST((SELECT {state} FROM split_rows WHERE is_scored ORDER BY row_id LIMIT 1) AS VARCHAR)"
    return f"""(WITH {sql.split(source)}, first AS (SELECT {first} AS s)
SELECT '{task.name}' AS task, count(*) FILTER (WHERE is_scored) AS n_scored, count(*) FILTER (WHERE split = 'test') AS n_test,
count(*) FILTER (WHERE split = 'train') AS n_train, '{task.problem}' AS problem, '{"Binary" if task.is_binary else "Choice"}' AS question_type,
'{task.instructions}' AS question, '{answers}' AS answers, (SELECT {sql.shortened('s', 110)} FROM first) AS state_preview,
arg_min(label, row_id) FILTER (WHERE is_scored) AS state_label FROM split_rows)"""


@query(
    "overview",
    "SELECT * FROM " + _overview_sql(DOC_LANG, sql.DOCS, LANG_STATE) + " UNION ALL SELECT * FROM "
    + _overview_sql(ORDER_STATUS, sql.ORDERS, ORDER_STATE),
)
def overview(spark, folder):
    rows = ((DOC_LANG, catalog.doc_lang_rows), (ORDER_STATUS, catalog.order_status_rows))
    return report.overview([report.describe(t, sampling.stratified_split(load(spark, folder))) for t, load in rows])


@query(
    "uses_subset",
    f"WITH {sql.split(sql.DOCS, 50)} SELECT count(*) FILTER (WHERE is_scored) < count(*) FILTER (WHERE split = 'test') AS uses_subset FROM split_rows",
)
def uses_subset(spark, folder):
    split = sampling.stratified_split(catalog.doc_lang_rows(spark, folder), scored_n=50)
    sizes = report.describe(DOC_LANG, split)
    long = sizes.select(
        "task", F.lit("task").alias("method"), F.lit("sizes").alias("field"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("n_scored", "n_test")])),
    )
    return report.uses_subset(long)


@query(
    "stack",
    f"""WITH {sql.split(sql.QUALITY)}
SELECT unnest(['stacked', 'control']) AS method, count(*) AS n, true AS valid FROM split_rows WHERE is_scored""",
)
def stack(spark, folder):
    """Baseline and judge stacked on the good/bad documents, next to the control: every scored row has a label and
    a probability from both."""
    split = stage(sampling.stratified_split(catalog.doc_quality_rows(spark, folder)), "split")
    train, test = split.where("split = 'train'"), split.where("is_scored")
    oof, probabilistic = models.oof_scores(DOC_QUALITY, train)
    scored = stage(DOC_QUALITY.baseline.fit(DOC_QUALITY, train).score(test), "test-scores")
    sample = sampling.stage2_sample(train, None)
    asked = build_requests(DOC_QUALITY, sample.unionByName(test), DOC_QUALITY.question(), judges.MODEL)
    records = score_rows(asked, judges.quality_judge())
    found = stack_models(DOC_QUALITY, sample, oof.select("row_id", "raw"), scored, probabilistic, records).predictions
    fits = F.col("pred").isin(list(DOC_QUALITY.labels)) & F.col("score").between(0, 1)
    return found.groupBy("method").agg(F.count("*").alias("n"), F.bool_and(fits).alias("valid"))


EVALUATED = "(SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label FROM embeddings)"
RUNS = ["baseline", "judge", "judge_3shot", "judge_cluster", "judge_cluster_random", "stack", "stack_cluster"]


@query(
    "evaluate",
    f"""WITH {sql.split(EVALUATED)}, n AS (SELECT count(*) FILTER (WHERE is_scored) AS scored, count(*) FILTER (WHERE split = 'test') AS test FROM split_rows)
SELECT unnest({RUNS}) AS method, 'metrics' AS field, CAST(scored AS DOUBLE) AS n FROM n
UNION ALL SELECT unnest(['stack', 'stack_cluster']), 'control_metrics', CAST(scored AS DOUBLE) FROM n
UNION ALL SELECT 'baseline', 'full_test_metrics', CAST(test AS DOUBLE) FROM n""",
)
def evaluate_all(spark, folder):
    """Baseline, judge (zero-shot, 3-shot, cluster, matched control) and stacks on vectors: the rows that every run was measured on."""
    results = evaluate.evaluate(
        spark, folder, ["vector_class"], lambda task, split: judges.VectorJudge(), model=judges.MODEL,
        variants=["0", "3", "cluster", "cluster-random"], scored_n=None,
    )
    return results.where("metric = 'n'").select("method", "field", F.col("value").alias("n"))


@query(
    "request_preview",
    f"""SELECT '{{"model":"{judges.MODEL}","state":' || {ORDER_STATE} || ',"questions":{{"label":'
|| '{ORDER_STATUS.question()}' || '}}}}' AS value FROM {sql.ORDERS} ORDER BY row_id LIMIT 2""",
)
def request_preview(spark, folder):
    """The first two requests of a run by row id, written as text and read back."""
    path = new_path(spark, "preview")
    built = build_requests(ORDER_STATUS, catalog.order_status_rows(spark, folder), ORDER_STATUS.question(), judges.MODEL)
    export_requests(built, ORDER_STATUS.question(), path, first=2)
    return spark.read.text(path)
