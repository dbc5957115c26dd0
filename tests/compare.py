"""Comparing a Spark result with a DuckDB result, row for row."""

import datetime
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def rows_of_spark(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def rows_of_duck(con, sql):
    result = con.execute(sql)
    return _table([d[0] for d in result.description], result.fetchall())


def kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def difference(got, want):
    """Empty when equal, else what differs first."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"row count {len(got[1])} != {len(want[1])}" + _sample(got, want)
    wrong = sum(a != b for a, b in zip(got[1], want[1]))
    return f"{wrong} rows differ" + _sample(got, want) if wrong else ""


def _sample(got, want):
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"\n   columns {got[0]}\n   spark {sorted(a - b)[:3]}\n   sql   {sorted(b - a)[:3]}"
