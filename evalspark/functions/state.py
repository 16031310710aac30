"""The nested document shown to a judge for one row: packing, size, shortening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import truncate

def state_json(state: Column) -> Column:
    """Compact JSON of a state; absent values stay as nulls."""
    return F.to_json(state, {"ignoreNullFields": "false"})


def state_size(state: Column) -> Column:
    return F.length(state_json(state))


def is_short(state: Column, limit: int | None) -> Column:
    """Whether the JSON of a state has at most ``limit`` characters; without a limit every state is short."""
    return F.lit(True) if limit is None else state_size(state) <= limit


def shorten(state: Column, dtype: T.DataType, limit: int | None) -> Column:
    """Cut every string of a nested state, at any depth of structs, to ``limit`` characters; without a limit nothing is cut."""
    if limit is None:
        return state
    if isinstance(dtype, T.StringType):
        return truncate(state, limit)
    if isinstance(dtype, T.StructType):
        fields = [shorten(state[f.name], f.dataType, limit).alias(f.name) for f in dtype.fields]
        return F.when(state.isNotNull(), F.struct(*fields))
    return state
