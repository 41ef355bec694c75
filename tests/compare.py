"""Run a query and its oracle and compare columns and rows, order aside."""

import math
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(record[i]) for i in order) for record in records]
    return sorted(rows, key=repr)


# Spark and DuckDB names of the column types that occur.
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def differences(spark, connection, name: str, sf_dir: str) -> list[str]:
    found = entry.queries()[name](spark, sf_dir)
    expected = connection.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in expected.description]
    kinds = {column[0]: TYPES.get(str(column[1]), str(column[1])) for column in expected.description}
    if sorted(found.columns) != sorted(columns):
        return [f"columns {sorted(found.columns)} != {sorted(columns)}"]
    problems = [
        f"type of {c}: {kind} != {kinds[c]}" for c, kind in found.dtypes if kind != kinds[c]
    ]
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    want = rows_of(columns, expected.fetchall())
    if got != want:
        extra = [r for r in got if r not in want][:3]
        missing = [r for r in want if r not in got][:3]
        problems.append(f"{len(got)} rows != {len(want)} rows; extra {extra}; missing {missing}")
    return problems
