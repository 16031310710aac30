"""The answer table: one record per answered request, appended batch by batch.

Every run that writes is a writer with a name of its own, and its batches lie under that name. Two runs,
or a run and a stream, never write to the same place; only a batch that its writer repeats replaces
itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("request_key", T.StringType()),
        T.StructField("p_yes", T.DoubleType()),  # binary question
        T.StructField("choice", T.StringType()),  # choice question, with the next two
        T.StructField("confidence", T.DoubleType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("error", T.StringType()),  # set when the request failed, all others null
    ]
)
STORED = T.StructType(
    RECORD.fields
    + [T.StructField("stored_at", T.TimestampType()), T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())]
)
# Which of several records of a key is the newest: by time, and repeatable among equal times.
NEWEST = ("stored_at", "writer", "batch")


def as_records(df: DataFrame) -> DataFrame:
    """``df`` in the record layout; columns it lacks are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All stored records with their time, writer and batch; empty when nothing is stored yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def read_answer_log(spark: SparkSession, path: str) -> DataFrame:
    """Records kept as JSON lines, with a ``seq`` number per line written."""
    return spark.read.schema(T.StructType(RECORD.fields + [T.StructField("seq", T.LongType())])).json(path)


# Field names of logged answers.
LOGGED = (
    "key string, error string, model string, latency_s double, usage struct<input_tokens: bigint>, "
    "answer struct<type: string, noul: double, choice: string, confidence: double, probabilities: map<string,double>>"
)


def read_nested_log(spark: SparkSession, path: str) -> DataFrame:
    """Records kept as JSON lines with the answer nested in them; a later line has a larger ``seq``.

    ``seq`` is the byte place of a line where Spark numbers it, which grows within a file, so the log
    must be one file or files whose keys do not overlap.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.from_json("value", LOGGED).alias("r"))
    return lines.where("r.key IS NOT NULL").select(
        F.col("r.key").alias("request_key"), F.col("r.answer.noul").alias("p_yes"), "r.answer.choice", "r.answer.confidence",
        "r.answer.probabilities", "r.model", "r.latency_s", F.col("r.usage.input_tokens").alias("input_tokens"), "r.error", "seq",
    )


def append_answers(answers: DataFrame, path: str, writer: str, batch: int) -> None:
    """Store the successful answers of one batch of a writer. A batch that is repeated replaces itself."""
    good = as_records(answers).where(F.col("error").isNull()).withColumn("stored_at", F.current_timestamp())
    good.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch}")


def latest_answers(store: DataFrame, key: str = "request_key", seq: str | Sequence[str] = NEWEST) -> DataFrame:
    """The newest record of every key. Aggregated, not ranked, so a key with many records is no burden."""
    values = [c for c in store.columns if c != key]
    order = F.col(seq) if isinstance(seq, str) else F.struct(*seq)
    newest = store.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_newest"))
    return newest.select(key, *[F.col(f"_newest.{c}").alias(c) for c in values])
