"""Region lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapanel.refdata import state_rows
from terrapanel.schemas import COUNTY_REFERENCE, conform


def crosswalk(spark: SparkSession) -> DataFrame:
    """Grid code, FIPS, postal: 48 rows as a literal table, whose size Spark knows."""
    rows = ", ".join(str(row) for row in state_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS states(region_code, state_fips, state_abbr)")


def state_lookup(spark: SparkSession) -> DataFrame:
    return crosswalk(spark).drop("region_code")


def county_dimension(df: DataFrame) -> DataFrame:
    """The canonical county list in its table layout."""
    return conform(df, COUNTY_REFERENCE)
