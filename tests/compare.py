"""Rows of a Spark query against rows of SQL in DuckDB, order aside."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    if sorted(spark_df.columns) != sorted(c[0] for c in found.description):
        return f"columns {spark_df.columns} and {[c[0] for c in found.description]}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
