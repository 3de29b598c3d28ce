"""Build every mart from the raw tables, and bring stored marts up to date by year.

A build writes all marts into a run folder of its own and marks it complete at the end. Readers take the newest complete run, so they
see the marts of one run, whole, during a build and after one that failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators.tables import PARTITION, YearTable
from terrapanel.operators.upsert import write_whole
from terrapanel.plans import marts
from terrapanel.plans.baselines import anomalies_from_parts, baseline_of_parts, baseline_parts
from terrapanel.plans.overlays import mart_overlay, overlay_branch, population_overlay
from terrapanel.refdata import BASELINE_END, BASELINE_START
from terrapanel.schemas import KEYS, STATE, Grain
from terrapanel.session import discard, exists, folders, mark, version_name

MARTS = ("mart_monthly", "mart_annual", "mart_overlay")
COMPLETE = "_COMPLETE"


def build_marts(
    raw_climate: DataFrame,
    raw_population: DataFrame | None,
    root: str,
    start: int = BASELINE_START,
    end: int = BASELINE_END,
    climate_dataset: str | None = None,
    grain: Grain = STATE,
) -> dict[str, DataFrame]:
    """Write the marts as a new run below root, partitioned by year, and return them as stored. Runs jobs.

    At county grain, or without population, there is no overlay mart: its datasets are by state.

    The raw climate table is read once: the annual mart is rolled up from the stored
    monthly one. climate_dataset, if given, adds the annual mean to the overlays under
    that id, so that it can be correlated with them.
    """
    spark = raw_climate.sparkSession
    run = f"{root.rstrip('/')}/run={version_name()}"

    def store(df: DataFrame, name: str) -> DataFrame:
        path = f"{run}/{name}"
        write_whole(df, path, "period_year", [grain.key if k == STATE.key else k for k in KEYS[name]])
        return spark.read.parquet(path)

    anomalies = marts.anomaly_by_region(marts.stage_climate(raw_climate, grain), start, end, grain)
    monthly = store(marts.mart_monthly(anomalies, grain), "mart_monthly")
    annual = store(marts.mart_annual(monthly, grain), "mart_annual")
    stored = dict(zip(MARTS, (monthly, annual)))
    if raw_population is not None and grain == STATE:
        branches = [population_overlay(marts.stage_population(raw_population))]
        if climate_dataset is not None:
            branches.append(overlay_branch(annual, climate_dataset, F.col("tavg_f")))
        stored["mart_overlay"] = store(mart_overlay(*branches), "mart_overlay")
    mark(spark, f"{run}/{COMPLETE}")
    return stored


def _complete_runs(spark: SparkSession, root: str) -> list[str]:
    runs = [f"{root.rstrip('/')}/{f}" for f in folders(spark, root) if f.startswith("run=")]
    return [r for r in runs if exists(spark, f"{r}/{COMPLETE}")]


def read_marts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The marts of the newest complete run below root."""
    runs = _complete_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"no complete run of the marts below {root}")
    return {m: spark.read.parquet(f"{runs[-1]}/{m}") for m in MARTS if m in folders(spark, runs[-1])}


def retire_runs(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove all but the newest complete runs, unfinished older ones included. To be called when no reader of an older one is left."""
    complete = _complete_runs(spark, root)
    if not complete:
        return []
    oldest = complete[-keep:][0]
    runs = [f"{root.rstrip('/')}/{f}" for f in folders(spark, root) if f.startswith("run=")]
    gone = [r for r in runs if r < oldest]
    discard(spark, *gone)
    return gone


def refresh_marts(
    raw_climate: DataFrame,
    years: list[int],
    parts: YearTable,
    monthly: YearTable,
    annual: YearTable,
    start: int = BASELINE_START,
    end: int = BASELINE_END,
    grain: Grain = STATE,
) -> list[int]:
    """Bring stored marts up to date after a load that touched some years. Runs jobs. Returns the years rewritten.

    The kept sums of the touched years are replaced and the baseline is taken from the sums. If none of the years is in the baseline's
    window, only they are read and rewritten; otherwise every month's anomaly may have moved, and all years are.
    """

    def of(table: DataFrame, wanted: list[int]) -> DataFrame:
        return table.where(F.col(PARTITION).isin(wanted))

    parts.replace_years(baseline_parts(marts.stage_climate(of(raw_climate, years), grain), grain))
    moved = any(start <= year <= end for year in years)
    rewritten = parts.years() if moved else sorted(years)
    normal = baseline_of_parts(parts.read(), start, end, grain)
    anomalies = anomalies_from_parts(marts.stage_climate(of(raw_climate, rewritten), grain), normal, grain)
    monthly.replace_years(marts.mart_monthly(anomalies, grain))
    annual.replace_years(marts.mart_annual(of(monthly.read(), rewritten), grain))
    return rewritten
