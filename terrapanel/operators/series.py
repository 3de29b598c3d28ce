"""Derived series. A series holds one row per period, which bounds every window here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrapanel.functions.values import null_if_nan


def moving_average(value: str, by: list[str], order: str = "period_year", window: int = 5) -> Column:
    """Centered mean over window // 2 rows on each side; edges shrink, missing values are skipped.

    Counts rows, not periods. Filter the range before, or the edges see rows outside it.
    """
    half = window // 2
    around = W.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return F.avg(null_if_nan(F.col(value).cast("double"))).over(around)


def percent_from_start(value: str, by: list[str], order: str = "period_year") -> Column:
    """Change in percent since the first row of the series; null when that is zero or missing."""
    whole = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    number = null_if_nan(F.col(value).cast("double"))
    return (number / F.nullif(F.first(number).over(whole), F.lit(0.0)) - 1) * 100


def nest_series(rows: DataFrame, requested: DataFrame, region: str, fields: list[str]) -> DataFrame:
    """One row per requested region with its rows as a year-ordered array, empty when it has none.

    requested holds (position, region); an array holds one element per year.
    """
    nested = rows.groupBy(region).agg(
        F.array_sort(F.collect_list(F.struct("period_year", *fields))).alias("series")
    )
    empty = F.array().cast(nested.schema["series"].dataType)
    return (
        requested.join(nested, region, "left")
        .withColumn("series", F.coalesce("series", empty))
        .orderBy("position")
    )


def correlation_of(x: Column, y: Column) -> Column:
    """Pearson r of the pairs that have both values; null for a constant side or no pair."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
