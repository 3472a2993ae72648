"""Runs a query on Spark and its SQL on DuckDB and compares them as multisets of rows."""

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _sorted_rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(record[i]) for i in order) for record in records]
    return [names[i] for i in order], sorted(rows, key=repr)


def difference(spark_df, con, text) -> str | None:
    """None when equal, otherwise what differs."""
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {text}").fetchall()}
    kinds = {name: KINDS.get(kind, kind) for name, kind in spark_df.dtypes}
    if kinds != described:
        wrong = {
            n: (kinds.get(n), described.get(n))
            for n in kinds.keys() | described.keys()
            if kinds.get(n) != described.get(n)
        }
        return f"schema: {wrong}"
    result = con.execute(text)
    names = [d[0] for d in result.description]
    expected = _sorted_rows(names, result.fetchall())
    got = _sorted_rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if got == expected:
        return None
    mine = [r for r in got[1] if r not in set(expected[1])][:3]
    theirs = [r for r in expected[1] if r not in set(got[1])][:3]
    return f"rows: {len(got[1])} against {len(expected[1])}; {got[0]}: {mine} against {theirs}"
