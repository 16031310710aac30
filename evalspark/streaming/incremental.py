"""Scoring rows as they arrive, with the answer table as the only memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.requests import DEFAULT_MODEL, build_requests
from evalspark.operators.scoring import Scorer, bodies, distinct_requests, missing_requests
from evalspark.plans.task import Task
from evalspark.sources.answers import append_answers, read_answers


def score_stream(
    task: Task, rows: DataFrame, question: str, scorer: Scorer, store_path: str, checkpoint: str,
    model: str = DEFAULT_MODEL, parallelism: int | None = None,
) -> StreamingQuery:
    """Ask for every new row whose request has no stored answer, and store the answers.

    ``rows`` is a streaming DataFrame. The stream keeps no state: what was answered is known from
    the answer table, whoever wrote it. The stream writes under the id of its query, which lives in the
    checkpoint, so a micro-batch that is repeated after a failure replaces its own answers and no others.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writer = f"stream-{spark.read.json(f'{checkpoint}/metadata').first()['id']}"
        stored = read_answers(spark, store_path)
        others = stored.where((stored["writer"] != writer) | (stored["batch"] != number))
        requests = build_requests(task, batch, question, model)
        todo = bodies(requests, missing_requests(distinct_requests(requests), others))
        if parallelism is not None:
            todo = todo.repartition(parallelism)
        append_answers(scorer.score(todo), store_path, writer, number)

    return (
        rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
