"""Compare a registered query with its SQL twin."""

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _sorted(records, names):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in places)) for r in records)


def assert_agrees(spark, db, sf: str, key: str) -> None:
    frame = queries()[key](spark, sf)
    cursor = db.execute(oracle_sql()[key])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _sorted(frame.collect(), frame.columns) == _sorted(cursor.fetchall(), names)
