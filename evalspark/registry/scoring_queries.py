"""Scoring through the answer table, and the numbers measured on the answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evalspark.functions.ordered import exact_percentiles
from evalspark.operators import metrics, sampling, scoring
from evalspark.operators.requests import build_requests
from evalspark.operators.stacking import judge_features
from evalspark.operators.window import WindowScorer
from evalspark.plans import catalog
from evalspark.plans.catalog import DOC_LANG, DOC_QUALITY
from evalspark.plans.evaluate import Examples, evaluate_variant, variant_named
from evalspark.plans.task import BINARY, Task
from evalspark.registry import judges, sql
from evalspark.registry.base import query
from evalspark.registry.column_queries import DOC_STATE, LANG_STATE, key_sql
from evalspark.session import new_path, stage
from evalspark.sources import answers, tables
from evalspark.streaming.incremental import score_stream

QUALITY_P = judges.quality_sql(DOC_STATE)
LANG_ANSWERS = judges.language_sql(sql.DOCS, LANG_STATE, "row_id, label")


def quality_requests(spark, folder):
    rows = catalog.doc_quality_rows(spark, folder)
    return build_requests(DOC_QUALITY, rows, DOC_QUALITY.question(), judges.MODEL)


def lang_records(spark, folder):
    rows = catalog.doc_lang_rows(spark, folder)
    requests = build_requests(DOC_LANG, rows, DOC_LANG.question(), judges.MODEL)
    return scoring.score_rows(requests, judges.LanguageJudge())


@query("score_rows", f"SELECT row_id, {QUALITY_P} AS p_yes FROM {sql.QUALITY}")
def score_rows(spark, folder):
    """Equal documents share a request, are asked once, and all get the answer."""
    return scoring.score_rows(quality_requests(spark, folder), judges.quality_judge()).select("row_id", "p_yes")


@query(
    "window_scoring",
    f"""SELECT row_id, CASE WHEN length(text) % 11 <> 0 THEN (length(text) % 10) / 10.0 END AS p_yes,
CASE WHEN length(text) % 11 = 0 THEN 'ValueError: no idea' END AS error FROM {sql.QUALITY}""",
)
def window_scoring(spark, folder):
    """All documents by an asynchronous judge, eight requests of a task in flight; some requests fail whenever they are asked."""

    async def ask(request):
        length = len(json.loads(request["state_json"])["document"])
        if length % 11 == 0:
            raise ValueError("no idea")
        return {"p_yes": length % 10 / 10}

    judge = WindowScorer(ask, window=8, retries=5, pause_s=0.0)
    return scoring.score_rows(quality_requests(spark, folder), judge).select("row_id", "p_yes", "error")


@query(
    "missing_requests",
    f"""WITH keyed AS (SELECT row_id, {key_sql(judges.MODEL, LANG_STATE, DOC_LANG.question())} AS request_key FROM {sql.DOCS})
SELECT row_id, request_key FROM keyed
WHERE request_key NOT IN (SELECT request_key FROM keyed WHERE row_id IN (SELECT doc_id FROM labels))""",
)
def missing_requests(spark, folder):
    """Documents without an answer when those with labels have been answered."""
    rows = catalog.doc_lang_rows(spark, folder)
    requests = build_requests(DOC_LANG, rows, DOC_LANG.question(), judges.MODEL)
    labelled = tables.load(spark, folder, "labels").select(F.col("doc_id").alias("row_id"))
    store = requests.join(labelled, "row_id", "left_semi").select("request_key").distinct()
    return scoring.missing_requests(requests, store).select("row_id", "request_key")


@query("resume_scoring", f"SELECT row_id, {QUALITY_P} AS p_yes, label = '1' AS was_stored FROM {sql.QUALITY}")
def resume_scoring(spark, folder):
    """A first run answers the rows of label 1; the second run asks only for the others.

    The second judge marks its answers, so ``was_stored`` shows which answers were reused.
    """
    rows = catalog.doc_quality_rows(spark, folder)
    requests = quality_requests(spark, folder).join(rows.select("row_id", "label"), "row_id")
    path = new_path(spark, "answer-table")
    first = requests.where("label = '1'").drop("label")
    scoring.score_rows(first, judges.quality_judge(), store_path=path, waves=2)
    marked = judges.quality_judge()
    marked.fields["latency_s"] = F.lit(1.0)
    again = scoring.score_rows(requests.drop("label"), marked, store_path=path)
    return again.select("row_id", "p_yes", F.col("latency_s").isNull().alias("was_stored"))


@query(
    "latest_answer",
    "SELECT user_id, event_id, event_type, value FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place = 1",
)
def latest_answer(spark, folder):
    log = tables.load(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    newest = answers.latest_answers(log, key="user_id", seq="event_id")
    return newest.select("user_id", "event_id", "event_type", "value")


@query(
    "answer_store",
    f"SELECT DISTINCT {key_sql(judges.MODEL, DOC_STATE, DOC_QUALITY.question())} AS request_key, "
    f"{QUALITY_P} AS p_yes FROM {sql.QUALITY} WHERE {QUALITY_P} >= 0.5",
)
def answer_store(spark, folder):
    """Records written to an answer table and read back: the failures (here, low scores) are not stored."""
    path = new_path(spark, "answer-store")
    requests = quality_requests(spark, folder)
    records = judges.quality_judge().score(scoring.bodies(requests, scoring.distinct_requests(requests)))
    failed = F.when(F.col("p_yes") < 0.5, F.lit("low")).alias("error")
    answers.append_answers(records.select("request_key", "p_yes", failed), path, "query", 0)
    return answers.latest_answers(answers.read_answers(spark, path)).select("request_key", "p_yes")


TURN = Task(
    name="turn", problem="Tell user turns from others", kind=BINARY, labels=("0", "1"),
    state=lambda: F.struct(F.col("text").alias("document")), instructions="Did a user write `document`?",
    criteria={"true": "A user wrote it.", "false": "Someone else wrote it."}, text="text",
)
TURN_ID = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


def turn_id():
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id")


@query(
    "incremental_scoring_stream",
    f"SELECT {TURN_ID} AS row_id, {judges.quality_sql(DOC_STATE)} AS p_yes FROM conversations",
)
def incremental_scoring_stream(spark, folder):
    """Conversation turns streamed into the answer table twice; the second run finds nothing to do."""
    path, question = new_path(spark, "stream-answers"), TURN.question()
    checkpoint = new_path(spark, "stream-checkpoint")
    source = tables.load(spark, folder, "conversations")
    row_id = turn_id()
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 16).parquet(
        f"{folder}/conversation[s].parquet"  # a pattern, so that a file or a folder of files will do
    )
    for _ in range(2):
        score_stream(
            TURN, stream.select(row_id, "text"), question, judges.quality_judge(), path, checkpoint, judges.MODEL
        ).awaitTermination()
    requests = build_requests(TURN, source.select(row_id, "text"), question, judges.MODEL)
    stored = answers.latest_answers(answers.read_answers(spark, path))
    return scoring.join_answers(requests, scoring.distinct_requests(requests), stored).select("row_id", "p_yes")


FROM_RUN = "text IN (SELECT text FROM conversations WHERE role = 'user')"


@query("shared_answer_store", f"SELECT {TURN_ID} AS row_id, {judges.quality_sql(DOC_STATE)} AS p_yes, {FROM_RUN} AS from_run FROM conversations")
def shared_answer_store(spark, folder):
    """A run stores the answers of user turns; then a stream with a checkpoint of its own scores all turns into
    the same store. All answers are there, and those of the run were not asked again."""
    path, question = new_path(spark, "shared-answers"), TURN.question()
    turns = tables.load(spark, folder, "conversations")
    marked = judges.quality_judge()
    marked.fields["latency_s"] = F.lit(1.0)
    first = build_requests(TURN, turns.where("role = 'user'").select(turn_id(), "text"), question, judges.MODEL)
    scoring.score_rows(first, marked, store_path=path, waves=2)
    stream = spark.readStream.schema(turns.schema).parquet(f"{folder}/conversation[s].parquet")
    score_stream(TURN, stream.select(turn_id(), "text"), question, judges.quality_judge(), path, new_path(spark, "checkpoint"),
                 judges.MODEL).awaitTermination()
    stored = answers.latest_answers(answers.read_answers(spark, path))
    requests = build_requests(TURN, turns.select(turn_id(), "text"), question, judges.MODEL)
    found = scoring.join_answers(requests, scoring.distinct_requests(requests), stored)
    return found.select("row_id", "p_yes", F.col("latency_s").isNotNull().alias("from_run"))


# ---------------------------------------------------------------- numbers

QUALITY_PRED = f"""(SELECT split, label, CASE WHEN p >= 0.5 THEN '1' ELSE '0' END AS pred, p AS score
FROM (SELECT *, {QUALITY_P} AS p FROM split_rows))"""


@query(
    "metrics_binary",
    f"WITH {sql.split(sql.QUALITY)} {sql.metric_columns(QUALITY_PRED, ['0', '1'], 'split', '1')}",
)
def metrics_binary(spark, folder):
    """The flagship: split, ask, decode and measure a judge on the good/bad documents."""
    split = sampling.stratified_split(catalog.doc_quality_rows(spark, folder))
    truth = stage(split.select("row_id", "split", "label"), "split")  # without the texts, which are read once
    records = scoring.score_rows(quality_requests(spark, folder), judges.quality_judge())
    pred = scoring.decode(DOC_QUALITY, records).join(truth, "row_id")
    return rounded(metrics.metrics(pred, DOC_QUALITY.labels, DOC_QUALITY.positive, by=["split"]))


def rounded(df, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "metrics_multiclass",
    "SELECT n, accuracy, macro_f1 FROM ("
    + sql.metric_columns(f"(SELECT 0 AS g, label, choice AS pred FROM ({LANG_ANSWERS}))", list(DOC_LANG.labels), "g", None)
    + ")",
)
def metrics_multiclass(spark, folder):
    truth = catalog.doc_lang_rows(spark, folder).select("row_id", "label")
    pred = scoring.decode(DOC_LANG, lang_records(spark, folder)).join(truth, "row_id")
    return rounded(metrics.metrics(pred, DOC_LANG.labels)).select("n", "accuracy", "macro_f1")


AUC_TIES = "(SELECT l_linestatus AS g, l_returnflag AS label, l_discount AS score FROM lineitem)"
AUC_WIDE = "(SELECT o_orderpriority AS g, o_orderstatus AS label, o_totalprice AS score FROM orders)"


@query("roc_auc_ties", f"SELECT g, round(auc, 6) AS roc_auc FROM ({sql.auc(AUC_TIES, 'g', 'R')})")
def roc_auc_ties(spark, folder):
    """A score with a handful of values, so nearly every pair is decided by ties."""
    rows = tables.load(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("g"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score")
    )
    return rounded(metrics.roc_auc(rows, "R", ["g"]))


@query("roc_auc", f"SELECT g, round(auc, 6) AS roc_auc FROM ({sql.auc(AUC_WIDE, 'g', 'F')})")
def roc_auc(spark, folder):
    """A score with almost as many values as rows."""
    rows = tables.load(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("score")
    )
    return rounded(metrics.roc_auc(rows, "F", ["g"]))


def event_log(spark, folder):
    """The events as an answer log: latency, tokens, and failures on some of them."""
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("timeout after "), F.floor("value").cast("string")))
    return tables.load(spark, folder, "events").select(
        F.pmod("user_id", F.lit(7)).alias("g"), "event_id", (F.col("value") / 10).alias("latency_s"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), error.alias("error"),
    )


LOG = """(SELECT user_id % 7 AS g, event_id, value / 10 AS latency_s, CAST(json_extract(props, '$.k') AS BIGINT) AS input_tokens,
CASE WHEN event_type = 'error' THEN 'timeout after ' || CAST(floor(value) AS BIGINT) END AS error FROM events)"""


@query(
    "usage_stats",
    f"""SELECT g, round(quantile_cont(latency_s, 0.5), 3) AS latency_p50_s, round(quantile_cont(latency_s, 0.95), 3) AS latency_p95_s,
CAST(sum(input_tokens) AS BIGINT) AS input_tokens_total FROM {LOG} WHERE error IS NULL GROUP BY g""",
)
def usage_stats(spark, folder):
    return metrics.usage_stats(event_log(spark, folder), ["g"])


NULL_LOG = LOG.replace("user_id % 7 AS g", "nullif(user_id % 7, 0) AS g")


@query(
    "usage_stats_null_group",
    f"""SELECT g, round(quantile_cont(latency_s, 0.5), 3) AS latency_p50_s, round(quantile_cont(latency_s, 0.95), 3) AS latency_p95_s,
CAST(sum(input_tokens) AS BIGINT) AS input_tokens_total FROM {NULL_LOG} WHERE error IS NULL GROUP BY g""",
)
def usage_stats_null_group(spark, folder):
    """Rows without a group are a group."""
    log = event_log(spark, folder)
    return metrics.usage_stats(log.withColumn("g", F.nullif(F.col("g"), F.lit(0).cast(log.schema["g"].dataType))), ["g"])


NULL_PRED = """(SELECT nullif(l_shipmode_group, 0) AS g, l_linestatus AS label, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS pred,
l_discount AS score FROM (SELECT *, l_linenumber % 3 AS l_shipmode_group FROM lineitem))"""


@query(
    "metrics_null_group",
    f"""SELECT n.g, n.n, accuracy, macro_f1, f1_positive, round(a.auc, 6) AS roc_auc FROM
({sql.metric_columns(NULL_PRED, ['O', 'F'], 'g', 'F').replace('USING (g)', 'ON m.g IS NOT DISTINCT FROM a.g').replace('m.*', 'm.g, m.n, m.accuracy, m.macro_f1, m.f1_positive')}) n
LEFT JOIN ({sql.auc(NULL_PRED, 'g', 'F')}) a ON n.g IS NOT DISTINCT FROM a.g""",
)
def metrics_null_group(spark, folder):
    """Binary metrics per group, one of which is null."""
    rows = tables.load(spark, folder, "lineitem").select(
        F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("g"), F.col("l_linestatus").alias("label"),
        F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("pred"), F.col("l_discount").alias("score"),
    )
    return rounded(metrics.metrics(rows, ["O", "F"], "F", by=["g"]))


@query(
    "error_summary",
    f"""SELECT g, CAST(sum(n) AS BIGINT) AS errors, string_agg(error, '; ' ORDER BY error) FILTER (WHERE place <= 3) AS error_examples
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY error) AS place
  FROM (SELECT g, error, count(*) AS n FROM {LOG} WHERE error IS NOT NULL GROUP BY g, error)) GROUP BY g""",
)
def error_summary(spark, folder):
    found = metrics.error_summary(event_log(spark, folder), ["g"])
    return found.select("g", "errors", F.array_join("error_examples", "; ").alias("error_examples"))


@query(
    "exact_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1""",
)
def percentiles(spark, folder):
    wanted = {"q25": 0.25, "q50": 0.5, "q99": 0.99}
    return rounded(exact_percentiles(tables.load(spark, folder, "lineitem"), "l_extendedprice", wanted, ["l_returnflag"]))


@query(
    "confidence_stats",
    f"""SELECT label, round(avg(CAST(choice = label AS INTEGER)) FILTER (WHERE confidence >= 0.8), 6) AS confident_accuracy,
round(avg(CAST(confidence >= 0.8 AS INTEGER)), 6) AS confident_share FROM ({LANG_ANSWERS}) GROUP BY label""",
)
def confidence_stats(spark, folder):
    truth = catalog.doc_lang_rows(spark, folder).select("row_id", "label")
    pred = scoring.decode(DOC_LANG, lang_records(spark, folder)).join(truth, "row_id")
    return rounded(metrics.confidence_stats(pred, ["label"]))


def _features_sql(absent: str = "p_{l} < 0.05") -> str:
    failed = "confidence < 0.4"
    logits = ", ".join(
        f"round(ln(q_{l} / (1 - q_{l})), 6) AS f_{l}" for l in judges.HINTS
    )
    clipped = ", ".join(
        f"greatest(least(CASE WHEN {failed} THEN 0.25::DOUBLE WHEN {absent.format(l=l)} THEN 0.0::DOUBLE ELSE p_{l} END, 0.9999::DOUBLE), 0.0001::DOUBLE) AS q_{l}"
        for l in judges.HINTS
    )
    return f"SELECT row_id, failed, {logits} FROM (SELECT row_id, {failed} AS failed, {clipped} FROM ({LANG_ANSWERS}))"


@query("judge_features", _features_sql())
def judge_features_query(spark, folder):
    """Logits of the judge's probabilities; here low ones are absent and unsure answers count as failed."""
    records = lang_records(spark, folder)
    kept = F.map_filter("probabilities", lambda _, p: p >= 0.05)
    unsure = F.when(F.col("confidence") < 0.4, F.lit("unsure"))
    partial = records.withColumn("probabilities", kept).withColumn("error", unsure)
    features = judge_features(DOC_LANG, partial)
    return features.select(
        "row_id", "failed", *[F.round(F.col("features")[i], 6).alias(f"f_{l}") for i, l in enumerate(judges.HINTS)]
    )


class SilentJudge(judges.LanguageJudge):
    """The language judge that returns nothing for requests it is unsure of."""

    def score(self, requests):
        # Written first: else the filter runs on the texts, and counts every hint again for each use of a count.
        return stage(super().score(requests), "judged").where(F.col("confidence") >= 0.4)


@query("dropped_answers", _features_sql(absent="false"))
def dropped_answers(spark, folder):
    """Requests that a judge passes over in silence count as failed, and get the prior."""
    rows = catalog.doc_lang_rows(spark, folder)
    requests = build_requests(DOC_LANG, rows, DOC_LANG.question(), judges.MODEL)
    features = judge_features(DOC_LANG, scoring.score_rows(requests, SilentJudge()))
    return features.select(
        "row_id", "failed", *[F.round(F.col("features")[i], 6).alias(f"f_{l}") for i, l in enumerate(judges.HINTS)]
    )


class UnsureJudge(judges.LanguageJudge):
    """The language judge that gives no answer when it is unsure."""

    def score(self, requests):
        records = super().score(requests)
        return records.withColumn("error", F.when(F.col("confidence") < 0.4, F.lit("unsure")))


ANSWERED = f"(SELECT * FROM ({LANG_ANSWERS}) WHERE confidence >= 0.4 AND row_id IN (SELECT row_id FROM split_rows WHERE is_scored))"
VARIANT_METRICS = sql.metric_columns(f"(SELECT 0 AS g, label, choice AS pred FROM {ANSWERED})", list(DOC_LANG.labels), "g", None)


@query(
    "judge_variant",
    f"""WITH {sql.split(sql.DOCS)}, m AS ({VARIANT_METRICS}),
c AS (SELECT round(avg(CAST(choice = label AS INTEGER)) FILTER (WHERE confidence >= 0.8), 6) AS confident_accuracy,
  round(avg(CAST(confidence >= 0.8 AS INTEGER)), 6) AS confident_share FROM {ANSWERED}),
e AS (SELECT count(*) FILTER (WHERE is_scored) - (SELECT n FROM m) AS errors FROM split_rows)
SELECT 'metrics' AS field, metric, value FROM (SELECT CAST(n AS DOUBLE) AS n, accuracy, macro_f1 FROM m) UNPIVOT (value FOR metric IN (n, accuracy, macro_f1))
UNION ALL SELECT 'details', metric, value FROM c UNPIVOT (value FOR metric IN (confident_accuracy, confident_share))
UNION ALL SELECT 'details', 'errors', CAST(errors AS DOUBLE) FROM e""",
)
def judge_variant(spark, folder):
    """One zero-shot run: scores over the answered rows of the test split, failures counted apart."""
    split = sampling.stratified_split(catalog.doc_lang_rows(spark, folder))
    shots = Examples(DOC_LANG, split.where("split = 'train'"))
    rows = evaluate_variant(DOC_LANG, split, variant_named("0"), shots, UnsureJudge(), judges.MODEL)
    return rounded(rows.where("value IS NOT NULL").select("field", "metric", "value"))
