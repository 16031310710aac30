"""Column expressions on labels, codes, numbers and probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities stay this far away from 0 and 1 before a logit is taken.
LOGIT_MARGIN = 1e-4


def binary_label(col: Column, positive: str) -> Column:
    """1 where the column equals ``positive``, else 0."""
    return (col == F.lit(positive)).cast("int")


def presence(col: Column) -> Column:
    """1 where a value is recorded, else 0."""
    return col.isNotNull().cast("int")


def map_code(col: Column, names: Mapping, strict: bool) -> Column:
    """Readable text for a code. An unknown code is an error when ``strict``, else null.

    A null code is null either way.
    """
    out = F.lit(None).cast("string")
    if strict:
        out = F.when(
            col.isNotNull(),
            F.raise_error(F.concat(F.lit("unknown code: "), col.cast("string"))).cast("string"),
        )
    for code, name in names.items():
        out = F.when(col == F.lit(code), F.lit(name)).otherwise(out)
    return out


def clipped_logit(p: Column, margin: float = LOGIT_MARGIN) -> Column:
    """ln(p / (1 - p)) with ``p`` kept inside [margin, 1 - margin]; null and NaN give null."""
    clipped = F.greatest(F.least(p, F.lit(1.0 - margin)), F.lit(margin))
    return F.when(p.isNotNull() & ~F.isnan(p), F.log(clipped / (F.lit(1.0) - clipped)))


def round_binary(value: Column, places: int) -> Column:
    """Rounded by the binary value, as printing a float does.

    ``F.round`` rounds the shortest decimal text instead, so 4.0135 (stored just below) would go up.
    """
    scale = float(10**places)
    return F.round(value * scale, 0) / scale


def share(part: Column, total: Column, places: int = 3) -> Column:
    return round_binary(part / total, places)


def argmax_label(scores: Sequence[Column], labels: Sequence[str]) -> Column:
    """The label of the highest score; the earlier label on ties."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(labels[-1])
    for score, label in reversed(list(zip(scores[:-1], labels[:-1]))):
        out = F.when(score == best, F.lit(label)).otherwise(out)
    return out


def null_if_nan(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)
