"""Positions and running sums of rows in a global order, without putting an order into one task.

Rows are dealt by range, sorted inside their partitions and written once, so each row has a fixed place in its
partition. Only the totals per partition and group (at most partitions + groups rows, as the order is by group
first) are added up across partitions; the running sum of a row is the total before its partition plus the sum before
it in there. Ties beyond the order are broken by the row's number in ``rows``, so copies of one row spread over
partitions too.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import stage


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str,
             sums: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with ``slot``, the number of rows before it in its group, and ``run``, the rows of its group; for each
    column of ``sums`` also the sum of the rows before it and, under ``<name>_total``, that of its whole group.

    A null in ``group`` is a group like any other; nulls come first. ``rows`` is read twice (for the ranges and for
    itself), so it should be a staged table.
    """
    group, sums = list(group), dict(sums or {})
    keys = [*group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it below
    placed = stage(dealt.select(*rows.columns, at.alias("_at")).withColumn("_part", F.shiftright("_at", 33)), name)

    parts = placed.groupBy("_part", *group).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*[F.col(g) for g in group])
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = {"_rows": "slot", **{f"_sum_{c}": n for c, n in sums.items()}}
    starts = parts.select(
        F.col("_part").alias("_of_part"), *[F.col(g).alias(f"_of_{g}") for g in group], "_first",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_start_{n}") for c, n in counted.items()],
        F.sum("_rows").over(whole).alias("run"), *[F.sum(f"_sum_{c}").over(whole).alias(f"{n}_total") for c, n in sums.items()])
    same = [F.col("_part") == F.col("_of_part"), *[F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]]
    if sums:
        inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for c, n in sums.items()])
    return placed.join(starts, functools.reduce(lambda a, b: a & b, same)).select(
        *rows.columns, (F.col("_start_slot") + F.col("_at") - F.col("_first")).alias("slot"), "run",
        *[(F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums.values()], *[f"{n}_total" for n in sums.values()])
