"""The sample panel taken through the models, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators.upsert import write_whole
from terrapanel.plans import marts
from terrapanel.plans.build import build_marts, read_marts
from terrapanel.plans.overlays import mart_overlay, overlay_branch, population_overlay
from terrapanel.plans.population import population_long
from terrapanel.registry.base import BASE_END, BASE_START
from terrapanel.schemas import COUNTY
from terrapanel.session import landed_once
from terrapanel.sources import population as sources
from terrapanel.sources import sample_tables as sample
from terrapanel.sources.regions import state_lookup


def staged(spark: SparkSession, sf: str) -> DataFrame:
    return marts.stage_climate(sample.state_panel(spark, sf))


def anomalies(spark: SparkSession, sf: str, start: int = BASE_START, end: int = BASE_END) -> DataFrame:
    return marts.anomaly_by_region(staged(spark, sf), start, end)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return marts.mart_monthly(anomalies(spark, sf))


def annual(spark: SparkSession, sf: str) -> DataFrame:
    return marts.mart_annual(anomalies(spark, sf))


def old_population(spark: SparkSession, sf: str) -> DataFrame:
    matrix = sources.read_json_matrix(spark, sample.landed_json(spark, sf), ["POP", "DATE_CODE", "state"])
    return sources.old_population(matrix, year_zero=sample.SAMPLE_YEAR_ZERO)


def new_population(spark: SparkSession, sf: str) -> DataFrame:
    newest = sample.VINTAGES[0]
    wide = sources.read_wide_csv(spark, f"{sample.landed_wide_csv(spark, sf)}/{newest}")
    return sources.new_population(wide, newest)


def population(spark: SparkSession, sf: str) -> DataFrame:
    return population_long(old_population(spark, sf), new_population(spark, sf), state_lookup(spark))


def stored_population(spark: SparkSession, sf: str) -> DataFrame:
    def write(path: str) -> None:
        write_whole(population(spark, sf), path, "period_year", ["state_fips"])

    return spark.read.parquet(landed_once(spark, "population", sf, write))


def _stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A mart at rest; all are built from the given tables once per session."""

    def write(root: str) -> None:
        raw, people = sample.state_panel(spark, sf), stored_population(spark, sf)
        build_marts(raw, people, root, BASE_START, BASE_END, "climate_tavg")

    return read_marts(spark, landed_once(spark, "marts", sf, write))[name]


def _stored_county(spark: SparkSession, sf: str, name: str) -> DataFrame:
    def write(root: str) -> None:
        build_marts(sample.county_panel(spark, sf), None, root, BASE_START, BASE_END, grain=COUNTY)

    return read_marts(spark, landed_once(spark, "county-marts", sf, write))[name]


def county_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_county(spark, sf, "mart_monthly")


def county_annual(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_county(spark, sf, "mart_annual")


def stored_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "mart_monthly")


def stored_annual(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "mart_annual")


def stored_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "mart_overlay")


def overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Population, and the climate mean as a second dataset."""
    climate = overlay_branch(annual(spark, sf), "climate_tavg", F.col("tavg_f"))
    return mart_overlay(population_overlay(population(spark, sf)), climate)
