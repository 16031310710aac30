"""Scoring rows with a judge through the answer table: ask only what is not answered yet."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.skew import lookup
from evalspark.operators.sampling import require_unique
from evalspark.plans.task import Task
from evalspark.session import stage
from evalspark.sources.answers import RECORD, append_answers, as_records, latest_answers, read_answers


# The error of a request for which the judge returned nothing.
NO_ANSWER = "no answer"


class Scorer(Protocol):
    """Turns request rows (request_key, model, state_json) into one record per request.

    A request that cannot be answered gives a record with ``error`` set; it does not stop the run.
    """

    def score(self, requests: DataFrame) -> DataFrame: ...


class Model(Protocol):
    """A fitted baseline: ``raw`` holds one value per label of the task."""

    probabilistic: bool

    def score(self, df: DataFrame) -> DataFrame: ...


class ColumnScorer:
    """A judge made of column expressions over ``state_json``, given by record field."""

    def __init__(self, **fields: Column) -> None:
        self.fields = fields

    def score(self, requests: DataFrame) -> DataFrame:
        return as_records(requests.select("request_key", "model", *[c.alias(n) for n, c in self.fields.items()]))


class BatchScorer:
    """A judge in Python: a function from a batch of requests to their records.

    For a remote model or a local one. When a batch raises, its requests are asked one by one, so only
    those that raise by themselves become error records.
    """

    def __init__(self, answer: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        self.answer = answer

    def score(self, requests: DataFrame) -> DataFrame:
        answer, names = self.answer, RECORD.names

        def asked(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                return answer(batch)
            except Exception as err:  # noqa: BLE001 - a failure is a record
                if len(batch) > 1:
                    return pd.concat([asked(batch.iloc[i : i + 1]) for i in range(len(batch))], ignore_index=True)
                return batch[["request_key"]].assign(error=f"{type(err).__name__}: {err}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                records = asked(batch).reindex(columns=names).astype(object)
                yield records.where(records.notna(), None)

        return requests.mapInPandas(run, RECORD)


class ModelScorer:
    """A judge made of a fitted baseline: states are decoded by schema and scored by the model, without a row leaving Spark.

    ``schema`` is the layout of the states and ``columns`` names the state field behind each column that the model reads. A binary task
    needs a model with probabilities. A state that is no such JSON gives an error record.
    """

    def __init__(self, task: Task, model: Model, schema: str, columns: Mapping[str, str]) -> None:
        if task.is_binary and not model.probabilistic:
            raise ValueError("a binary judge needs a model with probabilities")
        self.task, self.model, self.schema, self.columns = task, model, schema, dict(columns)

    def score(self, requests: DataFrame) -> DataFrame:
        state = F.from_json("state_json", f"{self.schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        unreadable = F.col("_state").isNull() | F.col("_state._corrupt").isNotNull()
        fields = [F.col(f"_state.{field}").alias(name) for name, field in self.columns.items()]
        rows = stage(requests.select("request_key", "model", state.alias("_state")).select(
            F.col("request_key").alias("row_id"), "model", *fields, unreadable.alias("_unreadable")), "model-requests")
        raw = F.col("raw")
        if self.task.is_binary:
            answer = [raw[1].alias("p_yes")]
        else:
            answer = [F.col("pred").alias("choice"), *([F.array_max(raw).alias("confidence")] if self.model.probabilistic else [])]
        scored = self.model.score(rows.where("not _unreadable").drop("_unreadable", "model")).select("row_id", *answer)
        joined = rows.select("row_id", "model", "_unreadable").join(scored, "row_id", "left")
        error = F.when(F.col("_unreadable"), F.lit("state cannot be read"))
        return as_records(joined.select(F.col("row_id").alias("request_key"), "model", *[c for c in scored.columns if c != "row_id"], error.alias("error")))


def missing_requests(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests without a stored answer."""
    return requests.join(store.select("request_key"), "request_key", "left_anti")


def distinct_requests(keys: DataFrame) -> DataFrame:
    """request_key, copies (how many rows share it) and row_id (the one row to ask with).

    Counted on keys and ids alone; copies are combined before the shuffle.
    """
    return keys.groupBy("request_key").agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id"))


def bodies(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """request_key, model, state_json of the asked rows. Row ids are unique, so no key is hot here."""
    return requests.join(asked.select("row_id"), "row_id", "left_semi").select("request_key", "model", "state_json")


def join_answers(keys: DataFrame, distinct: DataFrame, answers: DataFrame) -> DataFrame:
    """The record of every request row. A request without an answer gets a record with ``error`` set."""
    values = answers.select("request_key", *[f for f in RECORD.names if f != "request_key"])
    found = distinct.select("request_key", "copies").join(values, "request_key", "left")
    answered = (F.col("p_yes").isNotNull() & ~F.isnan("p_yes")) | F.col("choice").isNotNull()
    per_key = stage(found.withColumn("error", F.when(~answered, F.coalesce("error", F.lit(NO_ANSWER))).otherwise(F.col("error"))), "answers")
    found = lookup(keys.select("row_id", "request_key"), per_key, "request_key", "copies", how="left")
    return found.drop("copies")


def score_rows(
    requests: DataFrame, scorer: Scorer, store_path: str | None = None, parallelism: int | None = None,
    writer: str | None = None, waves: int = 1,
) -> DataFrame:
    """One record per request row: stored answers are reused, the rest is asked once per distinct request.

    ``parallelism`` bounds how many partitions ask at the same time. Only successes are stored, so
    failures are asked again by the next run. With several ``waves`` the missing requests are asked
    in as many parts, each stored when it is done, so an interrupted run loses one part at most.
    ``writer`` names this run in the store; by default a name that no other run has. Row ids must be unique.
    """
    spark = requests.sparkSession
    keys = stage(requests.select("row_id", "request_key"), "request-keys")
    require_unique(keys, "row_id")
    distinct = distinct_requests(keys)
    todo, known = distinct, []
    if store_path is not None:
        writer = writer or f"run-{uuid.uuid4().hex}"
        stored = read_answers(spark, store_path).where(F.col("writer") != writer)
        todo = missing_requests(distinct, stored)
        # Only the answers of these requests, however long the table has grown.
        wanted = stored.join(distinct.select("request_key"), "request_key", "left_semi")
        known.append(as_records(latest_answers(wanted)))
    if store_path is not None or waves > 1:
        todo = stage(todo.select("request_key", "row_id"), "asked")  # few of them move few texts
    for wave in range(waves):
        part = todo
        if waves > 1:
            part = part.where(F.pmod(F.xxhash64("request_key"), F.lit(waves)) == wave)
        part = bodies(requests, part)
        if parallelism is not None:
            part = part.repartition(parallelism)
        fresh = stage(scorer.score(part), "scored")
        known.append(as_records(fresh))
        if store_path is not None:
            append_answers(fresh, store_path, writer, wave)
    return join_answers(keys, distinct, functools.reduce(DataFrame.unionByName, known))


def decode(task: Task, records: DataFrame) -> DataFrame:
    """Add ``pred`` and ``score`` (P(positive), binary only) to the records."""
    if task.is_binary:
        negative, positive = task.labels
        return records.withColumn(
            "pred", F.when(F.col("p_yes") >= 0.5, F.lit(positive)).when(F.col("p_yes") < 0.5, F.lit(negative))
        ).withColumn("score", F.col("p_yes"))
    return records.withColumn("pred", F.col("choice")).withColumn("score", F.lit(None).cast("double"))
