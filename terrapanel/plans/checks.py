"""The rules every layer of the model has to meet, as one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from terrapanel.operators.quality import not_null, unique_key
from terrapanel.schemas import KEYS

# --- fixed values: columns that must not be null, per table -----------------
REQUIRED = {
    "raw_climate": ["state_fips", "period_year", "period_month"],
    "raw_population": ["state_fips", "period_year", "population"],
    "staged_climate": ["state_fips", "period_date"],
    "anomalies": ["state_fips"],
    "mart_monthly": ["state_fips"],
    "mart_annual": ["state_fips"],
    "staged_population": ["state_fips"],
    "mart_overlay": ["value"],
}
UNIQUE = ["mart_monthly", "mart_annual", "mart_overlay"]
# ---------------------------------------------------------------------------


def model_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rule for the given tables; each table is aggregated where it lies."""
    reports = [not_null(df, name, REQUIRED[name]) for name, df in tables.items()]
    reports += [unique_key(tables[name], name, KEYS[name]) for name in UNIQUE if name in tables]
    return reduce(DataFrame.unionByName, reports)
