"""Baselines from kept partial sums: total and count per region, month and year.

A year's sums only depend on that year's rows, so a load replaces those of the years it touched, and a mean over thirty years is taken from
thirty rows a region and month, without reading the panel again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators.tables import YearTable
from terrapanel.plans.marts import with_flags
from terrapanel.refdata import BASELINE_END, BASELINE_START
from terrapanel.schemas import STATE, Grain


def parts_schema(grain: Grain = STATE) -> T.StructType:
    return T.StructType(
        [
            T.StructField(grain.key, T.StringType()),
            T.StructField("period_month", T.IntegerType()),
            T.StructField("tavg_sum", T.DoubleType()),
            T.StructField("tavg_count", T.LongType()),
            T.StructField("period_year", T.IntegerType()),
        ]
    )


def parts_table(spark, name: str, root: str, grain: Grain = STATE) -> YearTable:
    return YearTable(spark, name, root, (grain.key, "period_month")).create(parts_schema(grain))


def baseline_parts(staged: DataFrame, grain: Grain = STATE) -> DataFrame:
    """Sum and count of the mean temperatures present, per region, month and year."""
    return staged.groupBy(grain.key, "period_month", "period_year").agg(
        F.sum("tavg_f").alias("tavg_sum"), F.count("tavg_f").alias("tavg_count")
    )


def baseline_of_parts(
    parts: DataFrame, start: int = BASELINE_START, end: int = BASELINE_END, grain: Grain = STATE
) -> DataFrame:
    """The same values as `marts.baseline`; null where a region's month was never measured in the window."""
    window = parts.where(F.col("period_year").between(start, end))
    total, count = F.sum("tavg_sum"), F.sum("tavg_count")
    return window.groupBy(grain.key, "period_month").agg(F.when(count > 0, total / count).alias("baseline_tavg_f"))


def anomalies_from_parts(staged: DataFrame, normal: DataFrame, grain: Grain = STATE) -> DataFrame:
    """Each month against a baseline that is known already."""
    return with_flags(staged.join(normal, [grain.key, "period_month"], "left"))
