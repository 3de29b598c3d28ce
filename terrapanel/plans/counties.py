"""The county dimension beside county rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def enrich_counties(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows with county name, state and land area; null where the dimension lacks the county."""
    named = dimension.select("fips_code", "county_name", "state_abbr", "land_sq_mi")
    return rows.join(named, "fips_code", "left")
