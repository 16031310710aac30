"""Runs a registered query and its SQL on the same tables and compares the results."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return repr([_cell(v) for v in value])
    if isinstance(value, dict):
        return repr(sorted((k, _cell(v)) for k, v in value.items()))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, sql: str, con) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    for name, dtype in df.dtypes:
        if dtype in KINDS and KINDS[dtype] != kinds[name]:
            return f"type of {name}: {dtype} instead of {kinds[name]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row {str(a)[:600]} instead of {str(b)[:600]}"
    return None
