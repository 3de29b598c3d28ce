"""Queries against their SQL twins."""

import duckdb
import pytest

from terrapanel.llm.queries import QUERIES
from terrapanel.llm.twins import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_agrees_with_sql(spark, key):
    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cursor = db.execute(ORACLES[key])
    names = [c[0] for c in cursor.description]
    frame = QUERIES[key](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in frame.select(*names).collect())


def test_all_dealt_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
