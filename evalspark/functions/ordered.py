"""Running totals and exact percentiles without putting a whole ordering into one task."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import stage

# Rows of a slice to aim at; the number of slices follows from the number of rows, within a range
# in which finding the slice of a row stays cheap.
SLICE_ROWS = 1_000_000
SLICES = (256, 8192)
STEP = 16


def _below(value: Column, bounds: Column) -> Column:
    # Never null, so that a join on it adds no null check that would run on the rows underneath.
    return F.coalesce(F.size(F.filter(bounds, lambda b: b < value)), F.lit(0))


def _with_slice(df: DataFrame, order: str, slices: int) -> DataFrame:
    """Add ``_slice``, the number of bounds below the value: it grows with the value.

    The bounds are approximate quantiles. A row looks at every 16th bound first, and then only at
    the bounds after the last one below.
    """
    cut_points = ", ".join(f"{i / slices}D" for i in range(1, slices))
    found = df.agg(F.expr(f"percentile_approx(`{order}`, array({cut_points}), 10000)").alias("all")).select(
        F.struct("all", F.filter("all", lambda _, i: i % STEP == STEP - 1).alias("rough"))
    )
    value = F.col(order)
    placed = df.withColumn("_bounds", found.scalar())
    placed = placed.withColumn("_start", _below(value, F.col("_bounds.rough")) * STEP)
    near = F.slice("_bounds.all", F.col("_start") + 1, F.lit(STEP))
    return placed.withColumn("_slice", F.col("_start") + _below(value, near)).drop("_bounds", "_start")


def _totals_before(df: DataFrame, by: list[str], order: str, totals: Mapping[str, str], overall: Mapping[str, str]) -> DataFrame:
    """Running totals by one window per group, for rows that fit into a task."""
    group = Window.partitionBy(*by)
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in totals.items()],
        *[F.sum(c).over(group).alias(name) for c, name in overall.items()])


def running_totals(
    df: DataFrame, by: Sequence[str], order: str, totals: Mapping[str, str], slices: int | None = None,
    overall: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add, per group, the total of each column over all rows ordered strictly before the row.

    ``df`` holds one row per (by, order) with a non-null ``order``; ``totals`` maps a summed
    column to the name of its running total, ``overall`` to that of its group total. The value range is cut at approximate quantiles into
    slices of about equal row counts. Each slice is summed on its own, and the slice totals (at
    most ``slices`` rows per group) give every slice its starting point. The bounds only balance
    the work; the totals are exact. By default there are as many slices as the rows ask for: rows that fit into one slice need no bounds and are
    ordered as they are. A null in ``by`` is a group like any other.
    """
    by = list(by)
    df = stage(df, "ordered-points")  # read for its size, its quantiles, the slice sums and the result
    if slices is None:
        points = df.count()
        if points <= SLICE_ROWS:
            return _totals_before(df, by, order, totals, overall or {})
        slices = min(max(SLICES[0], points // SLICE_ROWS), SLICES[1])
    sliced = _with_slice(df, order, slices)

    slice_sums = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slice_sums.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*by, "_slice"]],
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in totals],
        *[F.sum(f"_sum_{c}").over(Window.partitionBy(*by)).alias(name) for c, name in (overall or {}).items()],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_slice"]
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    summed = sliced.join(starts, same).drop(*[f"_of_{c}" for c in keys])
    for col, name in totals.items():
        summed = summed.withColumn(name, F.col(f"_start_{col}") + F.coalesce(F.sum(col).over(inside), F.lit(0)))
    return summed.drop("_slice", *[f"_start_{c}" for c in totals])


def exact_percentiles(df: DataFrame, value: str, percentages: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Exact, linearly interpolated percentiles of the non-null values, one row per group.

    ``percentages`` maps the name of a result column to its percentage as a fraction.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, by, value, {"_n": "_before"}, overall={"_n": "_size"})
    upto = F.col("_before") + F.col("_n")
    neighbours, results = [], []
    for name, p in percentages.items():
        position = F.lit(float(p)) * (F.col("_size") - 1)
        neighbours += [
            F.min(F.when(upto > F.floor(position), F.col(value))).alias(f"_low_{name}"),
            F.min(F.when(upto > F.ceil(position), F.col(value))).alias(f"_high_{name}"),
            F.first(position - F.floor(position)).alias(f"_part_{name}"),
        ]
        low, high, part = (F.col(f"_{side}_{name}") for side in ("low", "high", "part"))
        results.append((low * (1 - part) + high * part).alias(name))
    return ranked.groupBy(*by).agg(*neighbours).select(*by, *results)
