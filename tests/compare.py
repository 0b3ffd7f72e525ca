"""Compare a Spark result with a DuckDB result: names, row count, values in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def _kind(value) -> str:
    return type(value).__name__


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def kinds_of(names: list[str], rows) -> dict[str, set[str]]:
    return {n: {_kind(r[i]) for r in rows} - {"NoneType"} for i, n in enumerate(names)}


def difference(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    mine = result.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    if not mine:
        return "no rows"
    a, b = rows_of(result.columns, mine), rows_of(names, theirs)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: {x} != {y}"
    ka, kb = kinds_of(result.columns, mine), kinds_of(names, theirs)
    wrong = {n: (ka[n], kb[n]) for n in ka if ka[n] and kb[n] and ka[n] != kb[n]}
    return f"types {wrong}" if wrong else None
