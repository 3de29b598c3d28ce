"""Column layouts, key lists and region grains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURE_TYPE = T.DecimalType(6, 2)


@dataclass(frozen=True)
class Grain:
    """Which column identifies a region, and how its files name it."""

    key: str
    labels: tuple[str, ...]
    code_width: int
    scale: str

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.labels]

    @property
    def asked_by(self) -> str:
        """The column by which readers name a region."""
        return self.labels[0] if self.labels else self.key


STATE = Grain("state_fips", ("state_abbr",), 2, "ste")
COUNTY = Grain("fips_code", (), 5, "cty")

DAY_COLUMNS = [f"d{day:02d}" for day in range(1, 32)]
GRID_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ["region_type", "region_code", "region_name", "file_year", "file_month", "file_variable"]
        + DAY_COLUMNS
    ]
)


def _field(name: str, kind: T.DataType, required: bool = False) -> T.StructField:
    return T.StructField(name, kind, not required)


def _panel(region: list[T.StructField]) -> T.StructType:
    return T.StructType(
        region
        + [
            _field("period_year", T.IntegerType(), True),
            _field("period_month", T.IntegerType(), True),
            _field("tmax_f", MEASURE_TYPE),
            _field("tmin_f", MEASURE_TYPE),
            _field("tavg_f", MEASURE_TYPE),
            _field("prcp_in", MEASURE_TYPE),
            _field("source_file", T.StringType(), True),
            _field("ingested_at", T.DateType(), True),
            # not in the published layout: how good the files were, 0 for the final ones
            _field("status_rank", T.IntegerType()),
        ]
    )


# --- fixed values: names and types of the stored tables, their keys, and the columns that reads return ---

RAW_STATE_MONTHLY = _panel(
    [_field("state_fips", T.StringType(), True), _field("state_abbr", T.StringType(), True)]
)
RAW_COUNTY_MONTHLY = _panel([_field("fips_code", T.StringType(), True)])
COUNTY_REFERENCE = T.StructType(
    [
        _field("fips_code", T.StringType(), True),
        _field("county_name", T.StringType(), True),
        _field("state_abbr", T.StringType(), True),
        _field("state_fips", T.StringType(), True),
        _field("land_sq_mi", T.DecimalType(10, 2)),
    ]
)
POPULATION_ANNUAL = T.StructType(
    [
        _field("state_fips", T.StringType(), True),
        _field("state_abbr", T.StringType(), True),
        _field("period_year", T.IntegerType(), True),
        _field("population", T.LongType(), True),
        _field("source", T.StringType(), True),
        _field("ingested_at", T.DateType(), True),
    ]
)

KEYS = {
    "state_monthly": ["state_fips", "period_year", "period_month"],
    "county_monthly": ["fips_code", "period_year", "period_month"],
    "county_reference": ["fips_code"],
    "population_annual": ["state_fips", "period_year"],
    "mart_monthly": ["state_fips", "period_year", "period_month"],
    "mart_annual": ["state_fips", "period_year"],
    "mart_overlay": ["dataset", "state_fips", "period_year"],
}

ANNUAL_COLUMNS = [
    "state_fips", "state_abbr", "period_year", "tavg_f", "tmax_f", "tmin_f", "prcp_in",
    "anomaly_f", "months_reported", "is_partial_year", "has_data_gap",
]
MONTHLY_COLUMNS = [
    "state_fips", "state_abbr", "period_year", "period_month", "tavg_f", "tmax_f", "tmin_f",
    "prcp_in", "anomaly_f", "has_data_gap",
]


# ---------------------------------------------------------------------------


def mart_columns(columns: list[str], grain: Grain) -> list[str]:
    """A mart's columns at another grain than the state's."""
    return [*grain.columns, *[c for c in columns if c not in STATE.columns]]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order columns to a table layout; a column the frame lacks becomes a typed null."""

    def column(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in df.columns else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema])


def required_columns(schema: T.StructType) -> list[str]:
    return [field.name for field in schema if not field.nullable]
