"""Spark and DuckDB results as sorted lists of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else round(number, 6)
    return str(value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(t[i]) for i in order]) for t in tuples))


def duck(sql: str, sf_dir: str = SMALL):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), rows(names, result.fetchall())


def same(df, sql: str, sf_dir: str = SMALL) -> None:
    names, expected = duck(sql, sf_dir)
    assert sorted(df.columns) == names
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert found == expected
