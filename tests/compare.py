"""Spark result against DuckDB result, order-insensitive and exact."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb

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
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return 0.0 if value == 0 else value


def rows(names: list[str], records) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(record[i]) for i in order) for record in records)


# Spark's type names for DuckDB's
TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


def schemas(df, con, sql: str) -> tuple[dict, dict]:
    """Column types of both sides, by name."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    return dict(df.dtypes), {row[0]: TYPE_NAMES.get(str(row[1]), str(row[1])) for row in described}


def compare(df, con, sql: str) -> tuple[int, int, list, list]:
    """Row counts of both sides and what only one of them has."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    expected = rows(names, result.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    found = rows(df.columns, df.toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
    return (
        sum(found.values()),
        sum(expected.values()),
        list((found - expected).elements()),
        list((expected - found).elements()),
    )
