"""Compare a Spark result with its SQL check: same columns, rows and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return [columns[i] for i in order], out


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql: str):
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    return normal(names, relation.fetchall())


def differences(a, b, show: int = 3) -> list[str]:
    """Empty when equal."""
    if a[0] != b[0]:
        return [f"columns {a[0]} != {b[0]}"]
    if len(a[1]) != len(b[1]):
        return [f"rows {len(a[1])} != {len(b[1])}", str(a[1][:show]), str(b[1][:show])]
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return [f"{len(wrong)} rows differ"] + [f"{x} != {y}" for x, y in wrong[:show]] if wrong else []
