"""Joining a large table with a table of unique keys when a few keys hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most frequent keys are looked up from a broadcast of at most this many rows; each remaining
# key then holds less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1000


def lookup(facts: DataFrame, dim: DataFrame, key: str, frequency: str, how: str = "inner") -> DataFrame:
    """Add the columns of ``dim`` (one row per key) to every row of ``facts`` (inner or left).

    ``frequency`` is the column of ``dim`` that says how many fact rows use a key. Rows of the ``HOT_KEYS``
    most frequent keys are answered from a broadcast where they are read, rows without a key are as well, and
    only the others are shuffled, so no key that ``dim`` knows to be frequent meets in one task; one that
    it does not know is left to Spark's splitting of skewed joins. Both inputs are read twice, so they should be staged
    or cheap.
    """
    values = [c for c in dim.columns if c != key]
    packed = dim.select(key, F.struct(*values).alias("_value"), F.col(frequency).alias("_frequency"))
    hot = packed.orderBy(F.desc("_frequency"), key).limit(HOT_KEYS)
    cold = packed.join(F.broadcast(hot.select(key)), key, "left_anti").select(F.col(key).alias("_cold_key"), "_value")

    marked = facts.join(F.broadcast(hot.select(F.col(key).alias("_hot_key"), "_value")), F.col(key) == F.col("_hot_key"), "left")
    answered = F.col("_hot_key").isNotNull() | (F.col(key).isNull() if how == "left" else F.lit(False))
    known = marked.where(answered).drop("_hot_key")
    others = marked.where(F.col("_hot_key").isNull() & F.col(key).isNotNull()).drop("_hot_key", "_value")
    shuffled = others.join(cold, F.col(key) == F.col("_cold_key"), how).drop("_cold_key")
    return known.unionByName(shuffled).select(*facts.columns, *[F.col(f"_value.{c}").alias(c) for c in values])
