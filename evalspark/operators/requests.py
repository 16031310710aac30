"""Requests to a judge: few-shot questions, request rows and their keys."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import state as states
from evalspark.operators.sampling import local_table
from evalspark.plans.task import Task

DEFAULT_MODEL = "judge-latest"
KEY_SEPARATOR = "\u0001"


def fewshot_criteria(task: Task, shots: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per criterion: its description and the states of its examples, shortened if the task says so.

    ``shots`` is a selection of a few rows per label, so its lists are short. A criterion without
    a shot keeps an empty list.
    """
    spark = shots.sparkSession
    rows = [{"criterion": k, "description": v} for k, v in task.criteria.items()]
    criteria = local_table(spark, rows, pa.schema([("criterion", pa.string()), ("description", pa.string())]))
    stated = shots.select(
        task.criterion_key(F.col("label")).alias("criterion"), F.col(order).alias("place"),
        task.state().alias("state"),
    )
    short = states.shorten(F.col("state"), stated.schema["state"].dataType, task.example_text)
    lists = stated.select("criterion", "place", states.state_json(short).alias("state")).groupBy("criterion").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "state"))), lambda s: s["state"]).alias("examples")
    )
    empty = F.array().cast("array<string>")
    return criteria.join(lists, "criterion", "left").withColumn("examples", F.coalesce("examples", empty))


def question_json(task: Task, shots: DataFrame | None = None, order: str = "row_id") -> str:
    """The question, with the shots attached as examples when there are any.

    Every request of a run carries the same question, so it is one small text on the driver.
    """
    if shots is None:
        return task.question()
    rows = fewshot_criteria(task, shots, order).collect()
    return task.question({r["criterion"]: [json.loads(s) for s in r["examples"]] for r in rows})


def request_key(model: Column, state: Column, question: str) -> Column:
    """SHA-256 over model, state and question. The question is the same for all rows, so it is hashed once."""
    question_hash = hashlib.sha256(question.encode()).hexdigest()
    return F.sha2(F.concat_ws(KEY_SEPARATOR, model, state, F.lit(question_hash)), 256)


def build_requests(task: Task, rows: DataFrame, question: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """row_id, request_key, model, state_json. The question itself stays out of the rows."""
    stated = rows.select("row_id", F.lit(model).alias("model"), task.state_json().alias("state_json"))
    return stated.withColumn("request_key", request_key(F.col("model"), F.col("state_json"), question))


def request_body(requests: DataFrame, question: str) -> DataFrame:
    """The full JSON body of each request, as one column ``body``."""
    body = F.concat(
        F.lit('{"model":'), F.to_json(F.array("model")).substr(F.lit(2), F.length(F.to_json(F.array("model"))) - 2),
        F.lit(',"state":'), F.col("state_json"),
        F.lit(',"questions":{"label":'), F.lit(question), F.lit("}}"),
    )
    return requests.select("row_id", "request_key", body.alias("body"))


def export_requests(requests: DataFrame, question: str, path: str, first: int | None = None) -> None:
    """Write request bodies as text lines; ``first`` keeps the first rows by id, as a preview."""
    bodies = request_body(requests, question)
    if first is not None:
        bodies = bodies.orderBy("row_id").limit(first)
    bodies.select("body").write.mode("errorifexists").text(path)
