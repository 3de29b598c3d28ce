"""Raw panel to staging, anomaly and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrapanel.functions.values import first_of_month
from terrapanel.refdata import BASELINE_END, BASELINE_START, MEASURES
from terrapanel.schemas import STATE, Grain

_MEASURES = list(MEASURES.values())


def stage_climate(raw: DataFrame, grain: Grain = STATE) -> DataFrame:
    """Cast, add the first-of-month date, drop rows without a region or with a bad month."""
    extras = [c for c in ("source_file", "ingested_at") if c in raw.columns]
    return raw.where(F.col(grain.key).isNotNull() & F.col("period_month").between(1, 12)).select(
        *grain.columns,
        F.col("period_year").cast("int"),
        F.col("period_month").cast("int"),
        first_of_month(F.col("period_year").cast("int"), F.col("period_month").cast("int")).alias("period_date"),
        *[F.col(m).cast("double") for m in _MEASURES],
        *extras,
    )


def stage_population(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("state_fips").isNotNull()).select(
        "state_fips",
        "state_abbr",
        F.col("period_year").cast("int"),
        F.col("population").cast("long"),
        "source",
    )


def baseline(
    staged: DataFrame, start: int = BASELINE_START, end: int = BASELINE_END, grain: Grain = STATE
) -> DataFrame:
    """Mean temperature per region and calendar month over the inclusive window."""
    window = staged.where(F.col("period_year").between(start, end))
    return window.groupBy(grain.key, "period_month").agg(F.avg("tavg_f").alias("baseline_tavg_f"))


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"anomaly_f": anomaly(), "is_baseline_missing": F.col("baseline_tavg_f").isNull()}
    )


def anomaly() -> Column:
    return F.col("tavg_f") - F.col("baseline_tavg_f")


def anomaly_by_region(
    staged: DataFrame,
    start: int = BASELINE_START,
    end: int = BASELINE_END,
    grain: Grain = STATE,
) -> DataFrame:
    """Each month against its own region's mean for that calendar month.

    Written as a window, so a panel that is itself computed from daily rows is
    computed once. Rows are placed by region, which also serves the rollup and the
    series that follow without another exchange.

    Expects one row per region and month, as every aggregate to months gives (unique_key
    tells); a region's task then holds as many rows as there are months.
    """
    month = W.partitionBy(grain.key, "period_month")
    in_window = F.when(F.col("period_year").between(start, end), F.col("tavg_f"))
    placed = staged.repartition(grain.key)
    return with_flags(placed.withColumn("baseline_tavg_f", F.avg(in_window).over(month)))


def anomaly_by_region_join(
    staged: DataFrame,
    start: int = BASELINE_START,
    end: int = BASELINE_END,
    grain: Grain = STATE,
) -> DataFrame:
    """The same rows from a left join with the baseline.

    Suits a stored panel: the baseline reads two columns of the window's years, and
    when Spark finds it small enough to broadcast the panel itself is not shuffled.
    """
    normal = baseline(staged, start, end, grain)
    return with_flags(staged.join(normal, [grain.key, "period_month"], "left"))


def mart_monthly(anomalies: DataFrame, grain: Grain = STATE) -> DataFrame:
    return anomalies.select(
        *grain.columns,
        "period_year",
        "period_month",
        "period_date",
        *_MEASURES,
        "anomaly_f",
        "is_baseline_missing",
        (F.col("tavg_f").isNull() | F.col("is_baseline_missing")).alias("has_data_gap"),
    )


def mart_annual(anomalies: DataFrame, grain: Grain = STATE) -> DataFrame:
    """Yearly means, rain total, mean monthly anomaly and completeness.

    months_reported counts rows, measured or not; has_data_gap only tells of a missing baseline.
    """
    months = F.count("period_month")
    return anomalies.groupBy(*grain.columns, "period_year").agg(
        F.avg("tavg_f").alias("tavg_f"),
        F.avg("tmax_f").alias("tmax_f"),
        F.avg("tmin_f").alias("tmin_f"),
        F.sum("prcp_in").alias("prcp_in"),
        F.avg("anomaly_f").alias("anomaly_f"),
        months.alias("months_reported"),
        (months < 12).alias("is_partial_year"),
        F.bool_or("is_baseline_missing").alias("has_data_gap"),
    )
