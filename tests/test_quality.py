from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import rows
from terrapanel.operators import quality as q
from terrapanel.schemas import COUNTY_REFERENCE, KEYS, POPULATION_ANNUAL, RAW_COUNTY_MONTHLY, RAW_STATE_MONTHLY, conform, required_columns


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [("01", 2010, 1), ("01", 2011, 2), ("04", 2010, None), ("04", 2010, 5)],
        "state_fips string, period_year int, population long",
    )


def test_not_null(people):
    report = rows(q.not_null(people, "people", ["state_fips", "population"]), "subject")
    assert report == [("not_null", "people", "population", 1), ("not_null", "people", "state_fips", 0)]


def test_unique_key(people):
    assert rows(q.unique_key(people, "people", ["state_fips", "period_year"])) == [
        ("unique_key", "people", "state_fips+period_year", 1)
    ]


def test_unknown_outcome_fails_a_domain_rule(people):
    report = q.domain_check(people, "people", {"positive": F.col("population") > 1})
    assert report.first().failing_rows == 2


def test_completeness_and_missing_cells(spark, people):
    row = q.completeness(people, 2, 2010, "state_fips").first()
    assert (row.row_count, row.expected_rows, row.is_complete) == (4, 4, True)
    regions = spark.createDataFrame([("01",), ("04",)], "state_fips string")
    assert rows(q.missing_cells(people, regions, 2010, "state_fips")) == [("04", 2011)]


def test_panel_stats(spark, people):
    assert rows(q.panel_stats(people, "state_fips")) == [(4, 2, 2010, 2011)]
    assert rows(q.panel_stats(people.limit(0), "state_fips")) == [(0, 0, None, None)]


def test_raw_layouts(spark):
    panel = spark.createDataFrame([("01", "AL", 1991, 1, 83.565)], "state_fips string, state_abbr string, period_year int, period_month int, tmax_f double")
    raw = conform(panel, RAW_STATE_MONTHLY)
    assert raw.columns == RAW_STATE_MONTHLY.names
    row = raw.first()
    assert row.tmax_f == Decimal("83.57") and row.prcp_in is None
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        conform(panel.withColumn("tmax_f", F.lit(12345.0)), RAW_STATE_MONTHLY).collect()
    for schema, key in (
        (RAW_STATE_MONTHLY, "state_monthly"),
        (RAW_COUNTY_MONTHLY, "county_monthly"),
        (COUNTY_REFERENCE, "county_reference"),
        (POPULATION_ANNUAL, "population_annual"),
    ):
        assert set(KEYS[key]) <= set(required_columns(schema))
