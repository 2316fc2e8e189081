"""Compares a query's rows with its SQL in DuckDB."""

import os

import duckdb


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    try:
        return f"{float(value):.9g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


def expected(sql, folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    r = c.sql(sql)
    return rows_of(r.columns, r.fetchall())


def actual(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
