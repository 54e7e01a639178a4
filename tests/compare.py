"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def _sorted(rows):
    plain = [tuple(_plain(v) for v in row) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v) for v in row))


# Spark and SQL names of the types that results may have.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:
    """Empty if columns, types and rows agree."""
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    order = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    found = []
    if sorted(order) != names:
        return [f"columns {names} against {sorted(order)}"]
    for name, spark_type in df.dtypes:
        if TYPES.get(spark_type, spark_type) != types[name]:
            found.append(f"type of {name}: {spark_type} against {types[name]}")
    expected = _sorted([tuple(row[order.index(n)] for n in names) for row in cursor.fetchall()])
    actual = _sorted([tuple(row[n] for n in names) for row in df.collect()])
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows against {len(expected)}")
    unequal = [(a, e) for a, e in zip(actual, expected) if a != e]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found
