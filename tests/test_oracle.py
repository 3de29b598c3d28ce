"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sqltwin import assert_agrees, connect
from terrapanel.registry import ORACLES as PANEL_TWINS
from terrapanel.registry import QUERIES as PANEL_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(PANEL_QUERIES))
def test_agrees_with_sql(spark, db, key):
    assert_agrees(spark, db, SF, key)


def test_every_panel_query_has_a_twin():
    assert set(PANEL_QUERIES) == set(PANEL_TWINS)


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() == 70
    assert {"tavg_smooth_f", "tavg_pct_from_start", "has_data_gap"} <= set(frame.columns)


def test_range_order(spark):
    for key in ("order_by_year", "order_by_region_year", "states_trend", "profile_sort"):
        frame = queries()[key](spark, SF)
        keys = [c for c in ("state_abbr", "period_year", "period_month") if c in frame.columns]
        found = [tuple(r[k] for k in keys) for r in frame.collect()]
        assert found == sorted(found)
