"""Holds queries against their SQL: the same columns and the same rows, in any order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*' if Path(f'{sf_dir}/{t}.parquet').is_dir() else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime | date):
        return str(x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, connection) -> int:
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = rows_of(columns, found.fetchall()), rows_of(df.columns, df.collect())
    if want != got:
        missing, extra = [r for r in want if r not in set(got)][:3], [r for r in got if r not in set(want)][:3]
        raise AssertionError(f"{len(want)} rows of SQL, {len(got)} of Spark; only in SQL: {missing}; only in Spark: {extra}")
    return len(got)
