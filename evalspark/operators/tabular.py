"""Features of tables: imputing, standardising and one-hot encoding with a bucket for rare values.

Each fit is a few aggregates; each transform is a column expression or a join on the category.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.ordered import exact_percentiles
from evalspark.functions.skew import lookup
from evalspark.session import stage

# Fixed value: categories seen less often than this share one column.
MIN_FREQUENCY = 10
RARE = "__rare__"


def split_by_type(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """The numeric columns and the others, in schema order."""
    numeric = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in df.schema.fields if f.name in columns and f.name not in numeric]


def vector_width(df: DataFrame, column: str) -> int:
    """The length that all vectors of a column have; vectors of several lengths are an error."""
    found = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"vectors of {found['low']} to {found['high']} numbers in {column}")
    return found["high"] or 0


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of the non-null values of each column, all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(pairs))
    return {r["column"]: r["median"] for r in exact_percentiles(long, "value", {"median": 0.5}, ["column"]).collect()}


def most_frequent(df: DataFrame, column: str) -> str | None:
    """The most frequent non-null value; the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), column).first()
    return None if top is None else top[0]


@dataclass(frozen=True)
class Imputer:
    fill: dict[str, float | str | None]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fill.items()}
        return df.withColumns(filled) if filled else df


def fit_imputer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Imputer:
    """Median for numbers, most frequent value for categories."""
    fill: dict = dict(medians(df, numeric)) if numeric else {}
    fill.update({c: most_frequent(df, c) for c in categorical})
    return Imputer(fill)


@dataclass(frozen=True)
class Standardiser:
    centre: dict[str, tuple[float, float]]  # column -> mean, population standard deviation

    def column(self, name: str) -> Column:
        mean, spread = self.centre[name]
        return (F.col(name).cast("double") - F.lit(mean)) / F.lit(spread if spread > 0 else 1.0)


def fit_standardiser(df: DataFrame, columns: Sequence[str]) -> Standardiser:
    """A constant column becomes zero."""
    row = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    ).first()
    return Standardiser({c: (row[f"mean_{c}"] or 0.0, row[f"std_{c}"] or 0.0) for c in columns})


@dataclass(frozen=True)
class OneHot:
    """The frequent categories of one column, in order; every other value shares the rare bucket."""

    column: str
    frequencies: DataFrame  # category, n, bucket (staged)

    def bucketed(self, df: DataFrame, name: str) -> DataFrame:
        """Add the bucket of each row's category; one never seen goes to the rare bucket."""
        keyed = df.withColumn("_category", F.col(self.column))
        found = lookup(keyed, self.frequencies, "_category", "n", how="left")
        bucket = F.coalesce("bucket", F.lit(RARE))
        return found.withColumn(name, bucket).drop("_category", "n", "bucket")

    def positions(self) -> Positions:
        """The buckets numbered in ascending order, as a table."""
        codes = stage(ordinal_codes(self.frequencies, "bucket").select("_category", "code"), "bucket-codes")
        frequent = self.frequencies.where(F.col("bucket") != RARE).select("_category", "n")
        rare = codes.where(F.col("_category") == RARE).first()
        table = stage(frequent.join(codes, "_category"), "bucket-positions")
        return Positions(self.column, table, rare["code"] if rare else None, codes.count())


@dataclass(frozen=True)
class Positions:
    """The position of every frequent category (staged: _category, n, code), and that of all others, if there are any."""

    column: str
    table: DataFrame
    rare: int | None
    size: int

    def placed(self, df: DataFrame, name: str) -> DataFrame:
        """Add the position of each row's category; null for one never seen where no rare bucket is."""
        found = lookup(df.withColumn("_category", F.col(self.column)), self.table, "_category", "n", how="left")
        return found.withColumn(name, F.coalesce("code", F.lit(self.rare).cast("int"))).drop("_category", "n", "code")


def fit_one_hot(df: DataFrame, column: str, min_frequency: int = MIN_FREQUENCY) -> OneHot:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_category")).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") >= min_frequency, F.col("_category")).otherwise(F.lit(RARE)).alias("bucket")
    return OneHot(column, stage(counts.select("_category", "n", bucket), "categories"))


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """``_category, n, code``: the categories numbered from 0 in ascending order, as a table.

    Numbered within ranges of categories, so that no task holds all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_category")).agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange("_category").withColumn("_range", F.spark_partition_id()), "categories")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_category"))
    return ranged.withColumn("_place", place).join(starts, "_range").select(
        "_category", "n", (F.col("_start") + F.col("_place") - 1).cast("int").alias("code"))


def with_ordinal_code(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Add the code of each row's category; -1 where it is missing or was not seen."""
    found = lookup(df.withColumn("_category", F.col(column)), codes, "_category", "n", how="left")
    return found.withColumn(name, F.coalesce("code", F.lit(-1))).drop("_category", "n", "code")
