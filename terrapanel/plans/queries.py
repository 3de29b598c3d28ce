"""Parametrised reads of the marts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.values import split_ids
from terrapanel.operators.series import moving_average, nest_series, percent_from_start
from terrapanel.plans.overlays import correlate
from terrapanel.refdata import OVERLAYS
from terrapanel.schemas import ANNUAL_COLUMNS, MONTHLY_COLUMNS, STATE, Grain, mart_columns


class UnknownOverlay(LookupError):
    pass


class OverlayNotReady(NotImplementedError):
    pass


def requested_ids(ids: str | Iterable[str], limit: int | None = None) -> list[str]:
    """The regions asked for; more than a limit the caller sets are refused, never cut."""
    wanted = split_ids(ids)
    if not wanted:
        raise ValueError("name at least one region")
    if limit is not None and len(wanted) > limit:
        raise ValueError(f"at most {limit} regions at a time")
    return wanted


def live_overlay(dataset: str) -> tuple[str, str | None, str]:
    if dataset not in OVERLAYS:
        raise UnknownOverlay(dataset)
    if OVERLAYS[dataset][2] != "live":
        raise OverlayNotReady(dataset)
    return OVERLAYS[dataset]


def _in_years(start: int, end: int | None) -> Column:
    year = F.col("period_year")
    return year >= start if end is None else year.between(start, end)


def annual_map(annual: DataFrame, year: int, grain: Grain = STATE) -> DataFrame:
    return annual.where(F.col("period_year") == year).select(*mart_columns(ANNUAL_COLUMNS, grain))


def compare_years(annual: DataFrame, start: int, end: int, grain: Grain = STATE) -> DataFrame:
    """Both years' rows tagged by side; one year asked twice appears on both sides."""
    side = F.filter(
        F.array(
            F.when(F.col("period_year") == start, F.lit("start")),
            F.when(F.col("period_year") == end, F.lit("end")),
        ),
        lambda tag: tag.isNotNull(),
    )
    rows = annual.where(F.col("period_year").isin(start, end))
    return rows.select(F.explode(side).alias("side"), *mart_columns(ANNUAL_COLUMNS, grain))


def latest_year(monthly: DataFrame) -> DataFrame:
    return monthly.agg(F.max("period_year").alias("latest_year"))


def latest_month(monthly: DataFrame, year: int | None = None) -> DataFrame:
    """The compared year (newest if not given) and the last month it has; one pass. Fails when the plan runs if the
    year asked for has no rows."""
    rows = monthly if year is None else monthly.where(F.col("period_year") == year)
    last = rows.agg(F.max(F.col("period_year") * 100 + F.col("period_month")).alias("last"))
    if year is not None:
        missing = F.raise_error(F.lit(f"no rows for the year {year}")).cast("int")
        last = last.select(F.when(F.col("last").isNull(), missing).otherwise(F.col("last")).alias("last"))
    return last.select(
        F.floor(F.col("last") / 100).cast("int").alias("period_year"),
        (F.col("last") % 100).cast("int").alias("period_month"),
    )


def year_anomalies(monthly: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Mean anomaly of the two years, both cut at the last month of the end year."""
    last = latest_month(monthly, end).select(F.struct("period_year", "period_month")).scalar()
    rows = monthly.where(
        (F.col("period_year") == start) | (F.col("period_year") == last["period_year"])
    ).where(F.col("period_month") <= last["period_month"])
    return rows.groupBy("state_abbr", "period_year").agg(F.avg("anomaly_f").alias("anomaly_f"))


def average_temperature(monthly: DataFrame, start: int, end: int | None = None) -> DataFrame:
    return monthly.where(_in_years(start, end)).groupBy("state_abbr").agg(F.avg("tavg_f").alias("avg_tavg_f"))


def period_summary(
    monthly: DataFrame, start: int = 1991, end: int | None = None, grain: Grain = STATE
) -> DataFrame:
    """Per region: change between two years over the months the end year has, and the mean of all years.

    The end year and its last month come from a scalar subquery, the rest from one aggregate.
    """
    last = latest_month(monthly, end).select(F.struct("period_year", "period_month")).scalar()
    compared = F.col("period_month") <= last["period_month"]
    year = F.col("period_year")
    first_mean = F.avg(F.when(compared & (year == start), F.col("anomaly_f")))
    last_mean = F.avg(F.when(compared & (year == last["period_year"]), F.col("anomaly_f")))
    return (
        monthly.where(_in_years(start, end))
        .groupBy(grain.asked_by)
        .agg((last_mean - first_mean).alias("change_f"), F.avg("tavg_f").alias("avg_tavg_f"))
        .withColumns(
            {
                "start_year": F.lit(start),
                "end_year": last["period_year"],
                "months_compared": last["period_month"],
            }
        )
    )


def state_trend(
    annual: DataFrame, state: str, start: int = 1991, end: int | None = None, grain: Grain = STATE
) -> DataFrame:
    """One region's years; the region by postal abbreviation, or by FIPS code at county grain."""
    rows = annual.where(F.col(grain.asked_by) == state.strip().upper()).where(_in_years(start, end))
    return rows.select(*mart_columns(ANNUAL_COLUMNS, grain)).orderBy("period_year")


def in_regions(df: DataFrame, ids: list[str] | DataFrame, region: str = "state_abbr") -> DataFrame:
    """Rows of some regions: a short list is pushed to the scan, a frame of ids is semi-joined."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(region), region, "left_semi")
    return df.where(F.col(region).isin(ids))


def states_trend(
    annual: DataFrame,
    states: str | Iterable[str],
    start: int = 1991,
    end: int | None = None,
    limit: int | None = None,
    grain: Grain = STATE,
) -> DataFrame:
    rows = in_regions(annual, requested_ids(states, limit), grain.asked_by).where(_in_years(start, end))
    return rows.select(*mart_columns(ANNUAL_COLUMNS, grain)).orderBy(grain.asked_by, "period_year")


def overlay_response(
    overlay: DataFrame, dataset: str, states: str | Iterable[str], start: int = 1991, end: int | None = None
) -> DataFrame:
    """Per requested region, in the caller's order, its series (empty if it has none) with the dataset's label and unit."""
    label, unit, _ = live_overlay(dataset)
    rows = overlay.where(F.col("dataset") == dataset).where(_in_years(start, end))
    return nested_by_request(rows, states, ["value"]).withColumns(
        {"label": F.lit(label), "unit": F.lit(unit).cast("string")}
    )


def nested_by_request(rows: DataFrame, states: str | Iterable[str], fields: list[str]) -> DataFrame:
    """Series per requested region in the caller's order."""
    wanted = list(dict.fromkeys(requested_ids(states, None)))
    listed = rows.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(w) for w in wanted])).alias("position", "state_abbr")
    )
    return nest_series(in_regions(rows, wanted), listed, "state_abbr", fields)


def month_drilldown(monthly: DataFrame, state: str, month: int, grain: Grain = STATE) -> DataFrame:
    if not 1 <= month <= 12:
        raise ValueError("month must be 1-12")
    rows = monthly.where((F.col(grain.asked_by) == state.strip().upper()) & (F.col("period_month") == month))
    return rows.select(*mart_columns(MONTHLY_COLUMNS, grain)).orderBy("period_year")


def overlay_series(
    overlay: DataFrame,
    dataset: str,
    states: str | Iterable[str],
    start: int = 1991,
    end: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of one live dataset; a dataset that starts late gives a shorter series."""
    live_overlay(dataset)
    rows = in_regions(overlay.where(F.col("dataset") == dataset), requested_ids(states, limit))
    return (
        rows.where(_in_years(start, end))
        .select("state_abbr", "period_year", "value")
        .orderBy("state_abbr", "period_year")
    )


def correlation(overlay: DataFrame, dataset_a: str, dataset_b: str, state: str | None = None) -> DataFrame:
    rows = overlay if state is None else in_regions(overlay, [state.strip().upper()])
    return correlate(rows, dataset_a, dataset_b)


def trend_chart_series(
    annual: DataFrame,
    states: str | Iterable[str],
    start: int = 1991,
    end: int | None = None,
    metric: str = "anomaly_f",
    overlay: DataFrame | None = None,
    dataset: str = "census_population",
    window: int = 5,
    limit: int | None = None,
) -> DataFrame:
    """Chart lines: the smoothed metric, and the overlay as percent since its first year in range."""
    series = ["state_abbr"]
    lines = states_trend(annual, states, start, end, limit).select(
        F.lit("climate").alias("line"),
        "state_abbr",
        "period_year",
        moving_average(metric, series, window=window).alias("value"),
    )
    if overlay is None:
        return lines
    rebased = overlay_series(overlay, dataset, states, start, end, limit).select(
        F.lit("overlay").alias("line"),
        "state_abbr",
        "period_year",
        percent_from_start("value", series).alias("value"),
    )
    return lines.unionByName(rebased)


def drilldown_chart_series(monthly: DataFrame, state: str, month: int, window: int = 5) -> DataFrame:
    rows = month_drilldown(monthly, state, month)
    smooth = moving_average("tavg_f", ["state_abbr", "period_month"], window=window)
    return rows.select("state_abbr", "period_month", "period_year", smooth.alias("value"))


def period_map_series(summary: DataFrame, metric: str = "anomaly") -> DataFrame:
    """The mapped value per region and whether the end year is only partly compared."""
    value = "change_f" if metric == "anomaly" else "avg_tavg_f"
    partial = (F.col("months_compared") < 12) if metric == "anomaly" else F.lit(False)
    return summary.select(
        "state_abbr", F.col(value).alias("value"), partial.alias("is_partial_comparison")
    )


def flagship_trend(annual: DataFrame, window: int = 5) -> DataFrame:
    """Every region-year with its smoothed mean and anomaly and its change since the first year."""
    series = ["state_fips"]
    return annual.withColumns(
        {
            "tavg_smooth_f": moving_average("tavg_f", series, window=window),
            "anomaly_smooth_f": moving_average("anomaly_f", series, window=window),
            "tavg_pct_from_start": percent_from_start("tavg_f", series),
        }
    )
