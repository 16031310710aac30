"""Input tables: parquet folders and the delimited files of the public datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import stage

# The public files, by column name and type as they are published. ``row_id`` is added by the
# caller's key when a file has one, else by ``with_row_id``.
TITANIC = (
    "PassengerId int, Survived int, Pclass int, Name string, Sex string, Age double, SibSp int, Parch int, "
    "Ticket string, Fare double, Cabin string, Embarked string"
)
SMS = "label_str string, text string"
IMDB = "review string, sentiment string"
BBC = "category string, text string"
IRIS = "sepal_length double, sepal_width double, petal_length double, petal_width double, species string"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, line_breaks: bool = False) -> DataFrame:
    """A CSV file with a header; quoted fields may hold doubled quotes.

    With ``line_breaks`` they may hold line breaks too; such a file cannot be split, and is read by one task.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"')
        .option("mode", "FAILFAST").csv(path)
    )


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file without a header. Quotes are plain characters there."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """The counterpart of ``read_csv``: every text quoted, blanks kept."""
    (
        df.write.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_tsv(df: DataFrame, path: str) -> None:
    """The counterpart of ``read_tsv``; texts must hold no tab and no line break."""
    (
        df.write.option("sep", "\t").option("quote", "").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


COPIES = 10_000  # equal rows numbered by one task at a time


def with_row_id(df: DataFrame) -> DataFrame:
    """A row id for a file without a key: a hash of the row's content plus its number among equal rows.

    It does not depend on how Spark reads the file, so it is the same in every run. Rows whose content
    occurs once, as a rule nearly all, are not moved: only hashes are counted. The others are counted as whole, and a
    large count becomes rows again by an expansion that every task makes for a part of it.
    """
    content = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    hashed = df.withColumn("_content", content)
    repeated = stage(hashed.groupBy("_content").agg(F.count("*").alias("_copies")).where("_copies > 1"), "equal-rows")
    single = hashed.join(repeated, "_content", "left_anti").withColumn("_copy", F.lit(1).cast("long"))
    samples = hashed.join(repeated.select("_content"), "_content", "left_semi").groupBy("_content", *df.columns).agg(F.count("*").alias("_copies"))
    parts = samples.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"), F.lit(COPIES).cast("long"))))
    until = F.least(F.col("_from") + COPIES - 1, F.col("_copies"))
    spread = parts.repartition("_content", "_from")
    numbered = spread.withColumn("_copy", F.explode(F.sequence(F.col("_from"), until))).drop("_copies", "_from")
    row_id = F.concat("_content", F.lit("-"), F.col("_copy").cast("string"))
    return single.unionByName(numbered).withColumn("row_id", row_id).select(*df.columns, "row_id")
