"""Run a query in Spark and its SQL in DuckDB and compare the values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty if the frame and the SQL agree in columns, type families and values."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    expected = relation.fetchall()
    found = [tuple(row) for row in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    problems = []
    for name, spark_type in df.dtypes:
        wide = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}.get(spark_type)
        if wide and kinds[name] not in {wide, "STRING", "NUMBER"}:
            problems.append(f"type of {name}: {spark_type} vs {kinds[name]}")
    left, right = _rows(df.columns, found), _rows(names, expected)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows vs {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(left)} rows differ, first: {bad[0][0]} vs {bad[0][1]}")
    return problems
