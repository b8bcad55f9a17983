"""Compares a query's rows with those of its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that compares alike from either engine."""
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(v) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sql: str, sf: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def close(a: list[tuple], b: list[tuple]) -> bool:
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4 * max(1, abs(p)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))
