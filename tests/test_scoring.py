from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import requests as reqs
from evalspark.operators import sampling, scoring
from evalspark.operators.stacking import baseline_features, judge_features
from evalspark.plans.catalog import DOC_LANG, DOC_QUALITY, IRIS
from evalspark.registry import judges
from evalspark.registry.scoring_queries import SilentJudge
from evalspark.session import new_path
from evalspark.sources import answers
from evalspark.streaming.incremental import score_stream

TEXTS = ["good text", "bad text", "good text", "plain", "bad text", "bad text"]


class CountingJudge:
    """Writes every request it is asked to a folder, so the tests can see what was asked."""

    def __init__(self, path, **fields):
        self.path, self.inner = path, scoring.ColumnScorer(**fields)

    def score(self, requests):
        requests.write.mode("append").parquet(self.path)
        return self.inner.score(requests)


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "1") for i, t in enumerate(texts)], "row_id long, text string, label string")


def built(spark, texts=TEXTS):
    return reqs.build_requests(DOC_QUALITY, rows(spark, texts), DOC_QUALITY.question())


def p_good():
    return F.when(F.col("state_json").contains("good"), 0.9).otherwise(0.2)


def test_equal_rows_are_asked_once_and_all_answered(spark):
    asked = new_path(spark, "asked-test")
    got = scoring.score_rows(built(spark), CountingJudge(asked, p_yes=p_good())).orderBy("row_id").collect()
    assert [r["p_yes"] for r in got] == [0.9, 0.2, 0.9, 0.2, 0.2, 0.2]
    assert spark.read.parquet(asked).count() == 3


def test_stored_answers_are_reused_and_failures_asked_again(spark):
    asked, store = new_path(spark, "asked-test"), new_path(spark, "store-test")
    error = F.when(F.col("state_json").contains("bad"), F.lit("down"))
    first = scoring.score_rows(built(spark), CountingJudge(asked, p_yes=p_good(), error=error), store).collect()
    assert sum(r["error"] is not None for r in first) == 3
    assert answers.read_answers(spark, store).count() == 2
    second = scoring.score_rows(built(spark), CountingJudge(asked, p_yes=F.lit(0.1)), store, waves=3, parallelism=2).collect()
    assert sorted(r["p_yes"] for r in second) == [0.1, 0.1, 0.1, 0.2, 0.9, 0.9]
    assert spark.read.parquet(asked).count() == 4
    third = scoring.score_rows(built(spark), CountingJudge(asked, p_yes=F.lit(0.0)), store).collect()
    assert sorted(r["p_yes"] for r in third) == [0.1, 0.1, 0.1, 0.2, 0.9, 0.9]
    assert spark.read.parquet(asked).count() == 4


def test_other_examples_are_other_requests(spark):
    shots = sampling.shots_k(rows(spark, [f"text {i}" for i in range(9)]), ["1"], 2)
    zero, few = DOC_QUALITY.question(), reqs.question_json(DOC_QUALITY, shots)
    keys = [reqs.build_requests(DOC_QUALITY, rows(spark), q).first()["request_key"] for q in (zero, few)]
    assert keys[0] != keys[1]
    criteria = json.loads(few)["criteria"]
    assert [len(criteria[c]["examples"]) for c in ("true", "false")] == [2, 0]
    assert criteria["true"]["description"] == DOC_QUALITY.criteria["true"]
    assert json.loads(few)["instructions"] == json.loads(zero)["instructions"]


def test_request_body_is_json(spark):
    row = reqs.request_body(built(spark, ['say "hi"\n\\ é']), DOC_QUALITY.question()).first()
    body = json.loads(row["body"])
    assert body["state"] == {"document": 'say "hi"\n\\ é'} and body["model"] == reqs.DEFAULT_MODEL
    assert body["questions"]["label"]["type"] == "binary"


def test_request_preview(spark):
    path = new_path(spark, "preview-test")
    reqs.export_requests(built(spark), DOC_QUALITY.question(), path, first=1)
    assert [json.loads(r["value"])["state"]["document"] for r in spark.read.text(path).collect()] == ["good text"]


def test_batch_judge_turns_exceptions_into_records(spark):
    def answer(batch):
        if batch["state_json"].str.contains("bad").any():
            raise RuntimeError("no answer")
        return batch[["request_key"]].assign(p_yes=0.7, model="m")

    requests = built(spark).repartition(6, "request_key")
    got = {r["row_id"]: r for r in scoring.score_rows(requests, scoring.BatchScorer(answer), parallelism=1).collect()}
    # The batch raised; asked one by one, only the bad rows do.
    assert {i: r["error"] for i, r in got.items() if r["error"]} == {i: "RuntimeError: no answer" for i, t in enumerate(TEXTS) if "bad" in t}
    assert all(got[i]["p_yes"] == 0.7 for i, t in enumerate(TEXTS) if "bad" not in t)
    got = scoring.score_rows(built(spark, ["good text"] * 3), scoring.BatchScorer(answer)).collect()
    assert [r["p_yes"] for r in got] == [0.7] * 3


def test_a_request_without_answer_is_an_error(spark):
    def answer(batch):
        kept = batch[~batch["state_json"].str.contains("bad")]
        return kept[["request_key"]].assign(p_yes=[float("nan") if "plain" in s else 0.7 for s in kept["state_json"]])

    records = scoring.score_rows(built(spark), scoring.BatchScorer(answer))
    got = {r["row_id"]: r["error"] for r in records.collect()}
    assert got == {i: None if "good" in t else scoring.NO_ANSWER for i, t in enumerate(TEXTS)}
    features = {r["row_id"]: (r["failed"], r["features"][0]) for r in judge_features(DOC_QUALITY, records).collect()}
    assert all(features[i] == (True, 0.0) for i, t in enumerate(TEXTS) if "good" not in t)


def test_row_ids_must_be_unique(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "row_id long, text string")
    requests = reqs.build_requests(DOC_QUALITY, twice, DOC_QUALITY.question())
    with pytest.raises(ValueError, match="unique"):
        scoring.score_rows(requests, scoring.ColumnScorer(p_yes=F.lit(0.5)))


def test_a_run_and_a_new_stream_share_a_store(spark):
    store, source = new_path(spark, "shared-test"), new_path(spark, "shared-source")
    scoring.score_rows(built(spark), scoring.ColumnScorer(p_yes=p_good()), store)
    assert answers.read_answers(spark, store).count() == 3
    rows(spark, ["new text", "good text"]).write.parquet(source)
    for _ in range(2):  # another checkpoint each time
        stream = spark.readStream.schema("row_id long, text string, label string").parquet(source)
        score_stream(DOC_QUALITY, stream, DOC_QUALITY.question(), scoring.ColumnScorer(p_yes=F.lit(0.4)), store,
                     new_path(spark, "shared-checkpoint")).awaitTermination()
    found = answers.latest_answers(answers.read_answers(spark, store)).collect()
    assert sorted(r["p_yes"] for r in found) == [0.2, 0.2, 0.4, 0.9]


def test_nested_answer_log(spark, tmp_path):
    path = tmp_path / "nested.jsonl"
    path.write_text(
        '{"key":"a","answer":{"type":"binary","noul":0.5},"model":"m","latency_s":0.1,"usage":{"input_tokens":3}}\n'
        '{"key":"b","error":"down"}\n'
        '{"key":"a","answer":{"type":"binary","noul":0.75},"model":"m","latency_s":0.2,"usage":{"input_tokens":4}}\n'
        '{"key":"c","answer":{"type":"choice","choice":"x","confidence":0.7,"probabilities":{"x":0.7}}}\n')
    got = {r["request_key"]: r for r in answers.latest_answers(answers.read_nested_log(spark, str(path)), seq="seq").collect()}
    assert (got["a"]["p_yes"], got["a"]["input_tokens"]) == (0.75, 4) and got["b"]["error"] == "down"
    assert got["c"]["probabilities"] == {"x": 0.7}


def test_many_copies_of_one_request(spark):
    """One key with most of the rows takes the broadcast side of the lookup."""
    texts = ["same"] * 3000 + [f"other {i}" for i in range(1500)]
    got = scoring.score_rows(built(spark, texts), scoring.ColumnScorer(p_yes=F.length("state_json") / 100.0))
    assert got.count() == 4500 and got.where("p_yes IS NULL").count() == 0
    assert got.select("row_id").distinct().count() == 4500


def test_latest_answer_wins(spark):
    log = spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 3), ("a", 0.5, 2), ("b", 0.3, 1)], "request_key string, p_yes double, seq int")
    got = {r["request_key"]: r["p_yes"] for r in answers.latest_answers(log, seq="seq").collect()}
    assert got == {"a": 0.9, "b": 0.3}


def test_answer_log_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"request_key":"a","p_yes":0.5,"seq":1}\n{"request_key":"a","choice":"x","probabilities":{"x":0.7},"seq":2}\n')
    got = answers.latest_answers(answers.read_answer_log(spark, str(path)), seq="seq").collect()
    assert [(r["choice"], r["probabilities"]) for r in got] == [("x", {"x": 0.7})]


def test_decoding(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (None,)], "p_yes double")
    assert [r["pred"] for r in scoring.decode(DOC_QUALITY, df).collect()] == ["1", "0", None]
    df = spark.createDataFrame([("en",)], "choice string")
    row = scoring.decode(DOC_LANG, df).first()
    assert row["pred"] == "en" and row["score"] is None


def test_judge_features_keep_failed_rows_with_a_prior(spark):
    schema = "row_id int, p_yes double, probabilities map<string,double>, error string"
    df = spark.createDataFrame([(0, 0.9, None, None), (1, None, None, "down"), (2, 1.0, None, None)], schema)
    got = {r["row_id"]: (r["features"][0], r["failed"]) for r in judge_features(DOC_QUALITY, df).collect()}
    assert got[0] == (pytest.approx(2.1972245), False) and got[1] == (0.0, True) and got[2][0] == pytest.approx(9.21024)
    df = spark.createDataFrame([(0, None, {"setosa": 0.5, "virginica": 0.5}, None), (1, None, None, "down")], schema)
    got = {r["row_id"]: r["features"] for r in judge_features(IRIS, df).collect()}
    assert got[0] == pytest.approx([0.0, -9.21024, 0.0], abs=1e-4) and got[1] == pytest.approx([-0.693147] * 3, abs=1e-5)


def test_baseline_features(spark):
    df = spark.createDataFrame([(0, [0.1, 0.9]), (1, [1.0, 0.0])], "row_id int, raw array<double>")
    got = {r["row_id"]: r["features"] for r in baseline_features(DOC_QUALITY, df, True).collect()}
    assert got[0] == pytest.approx([2.1972245]) and got[1] == pytest.approx([-9.21024], abs=1e-4)
    got = {r["row_id"]: r["features"] for r in baseline_features(DOC_QUALITY, df, False).collect()}
    assert got == {0: [0.9], 1: [0.0]}


def test_stream_scores_new_files_only(spark):
    source, store = new_path(spark, "stream-test"), new_path(spark, "stream-store-test")
    checkpoint, asked = new_path(spark, "stream-check-test"), new_path(spark, "stream-asked-test")

    def run():
        stream = spark.readStream.schema("row_id long, text string, label string").parquet(source)
        judge = CountingJudge(asked, p_yes=p_good())
        score_stream(DOC_QUALITY, stream, DOC_QUALITY.question(), judge, store, checkpoint).awaitTermination()
        return spark.read.parquet(asked).count()

    rows(spark).write.parquet(source)
    assert run() == 3
    assert run() == 3
    rows(spark, ["good text", "new text"]).write.mode("append").parquet(source)
    assert run() == 4
    assert answers.read_answers(spark, store).count() == 4


def test_a_fitted_model_as_judge(spark):
    class ByLength:
        """P(long) grows with the text; a null text is short."""

        probabilistic = True

        def score(self, df):
            p = F.least(F.coalesce(F.length("text"), F.lit(0)) / 10.0, F.lit(1.0))
            return df.select("row_id", F.when(p >= 0.5, "1").otherwise("0").alias("pred"), F.array(1 - p, p).alias("raw"))

    states = [("a", '{"document":"xxxxxxxx","other":1}'), ("b", '{"document":"xx"}'), ("c", '{"document":null}'), ("d", "{broken"), ("e", None)]
    requests = spark.createDataFrame([(k, "m", s) for k, s in states], "request_key string, model string, state_json string")
    judge = scoring.ModelScorer(DOC_QUALITY, ByLength(), "document string", {"text": "document"})
    got = {r["request_key"]: (r["p_yes"], r["error"]) for r in judge.score(requests).collect()}
    assert got == {"a": (0.8, None), "b": (0.2, None), "c": (0.0, None), "d": (None, "state cannot be read"), "e": (None, "state cannot be read")}
    judge = scoring.ModelScorer(DOC_LANG, ByLength(), "article string", {"text": "article"})
    (row,) = judge.score(requests.where("request_key = 'a'").selectExpr("request_key", "model", "replace(state_json, 'document', 'article') AS state_json")).collect()
    assert row["choice"] == "1" and row["confidence"] == 0.8
    margins = ByLength()
    margins.probabilistic = False
    with pytest.raises(ValueError):
        scoring.ModelScorer(DOC_QUALITY, margins, "document string", {"text": "document"})


def test_a_silent_judge_counts_each_hint_once(spark):
    texts = ["the man and the thing", "ich und du", "nada", None]
    asked = reqs.build_requests(DOC_LANG, rows(spark, texts).withColumn("label", F.lit("en")), DOC_LANG.question())
    found = SilentJudge().score(asked)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") <= len(judges.HINTS)
    wanted = [r for r in judges.LanguageJudge().score(asked).collect() if r["confidence"] is not None and r["confidence"] >= 0.4]
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted)) and 0 < len(wanted) < len(texts)
