"""Compare a Spark result with the SQL equivalent of its query."""

from __future__ import annotations

import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r)
    )


def compare(df, con, sql):
    """(equal, message): columns by name, then rows as a multiset."""
    spark_names = df.columns
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    if sorted(spark_names) != sorted(sql_names):
        return False, f"columns differ: {sorted(set(spark_names) ^ set(sql_names))}"
    ours, theirs = _rows(spark_names, df.collect()), _rows(sql_names, cursor.fetchall())
    if ours == theirs:
        return True, f"{len(ours)} rows"
    only_ours = [r for r in ours if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(ours)][:3]
    return False, f"{len(ours)} vs {len(theirs)} rows; {sorted(spark_names)} {only_ours} != {only_theirs}"
