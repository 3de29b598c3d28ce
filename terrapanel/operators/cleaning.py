"""From wide text days to one converted value per region, variable and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.values import celsius_to_fahrenheit, mm_to_inches, pad_key, readings_of
from terrapanel.operators.tables import bucketed_copy
from terrapanel.refdata import MEASURES, STATUSES, SUMMED
from terrapanel.schemas import DAY_COLUMNS, STATE, Grain
from terrapanel.session import fresh_path


def fold_days(grid: DataFrame, day_columns: list[str] = DAY_COLUMNS) -> DataFrame:
    """Replace the day columns by day_total and day_count over the readings present.

    Stays within the row, so no shuffle; a row without any reading keeps count 0.
    """
    readings = readings_of([F.col(day) for day in day_columns])
    others = [name for name in grid.columns if name not in day_columns]
    return grid.select(*others, readings.alias("readings")).select(
        *others,
        F.aggregate("readings", F.lit(0.0), lambda total, value: total + value).alias("day_total"),
        F.size("readings").alias("day_count"),
    )


def month_mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def month_sum(total: Column, count: Column) -> Column:
    """Null, not zero, when nothing was measured."""
    return F.when(count > 0, total)


def month_value(variable: Column, total: Column, count: Column) -> Column:
    """Sum in inches for summed variables, mean in Fahrenheit for the others."""
    return F.when(variable.isin(*SUMMED), mm_to_inches(month_sum(total, count))).otherwise(
        celsius_to_fahrenheit(month_mean(total, count))
    )


def fold_month(grid: DataFrame) -> DataFrame:
    folded = fold_days(grid)
    value = month_value(F.col("variable"), F.col("day_total"), F.col("day_count"))
    return folded.withColumn("value", value).drop("day_total", "day_count")


def map_codes(df: DataFrame, crosswalk: DataFrame, code: str = "region_code") -> DataFrame:
    """Grid codes to real region keys; rows of unknown codes are dropped.

    The 48-row crosswalk is a literal table of known size, so Spark broadcasts it by
    its own size check; a larger one supplied instead is joined by shuffle.
    """
    return df.join(crosswalk.withColumnRenamed("region_code", code), code).drop(code)


def unmapped(df: DataFrame, crosswalk: DataFrame, code: str = "region_code") -> DataFrame:
    """Rows whose code the crosswalk does not know."""
    return df.join(crosswalk.select(F.col("region_code").alias(code)), code, "left_anti")


def distinct_codes(df: DataFrame, code: str = "region_code") -> DataFrame:
    return df.select(code).distinct()


def region_key(df: DataFrame, grain: Grain, crosswalk: DataFrame | None = None) -> DataFrame:
    """State files go through the crosswalk; county files only pad their own code."""
    if grain == STATE:
        return map_codes(df, crosswalk)
    return df.withColumn(grain.key, pad_key(F.col("region_code"), grain.code_width)).drop("region_code")


def pivot_variables(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per key with a column per variable, null where a variable has no row.

    One conditional aggregate, so a single exchange. A (key, variable) pair holds
    one row; a second one fails when the plan runs.
    """

    def cell(variable: str) -> Column:
        mine = F.col("variable") == variable
        shown = [F.coalesce(F.col(key).cast("string"), F.lit("null")) for key in keys]
        twice = F.raise_error(F.concat_ws(" ", F.lit(f"several rows of {variable} for"), *shown))
        return F.when(F.count_if(mine) > 1, twice.cast(long.schema[value].dataType)).otherwise(
            F.max(F.when(mine, F.col(value)))
        )

    return long.groupBy(*keys).agg(*[cell(variable).alias(column) for variable, column in MEASURES.items()])


def totals_of_best_status(
    readings: DataFrame, keys: list[str], value: Column, rank: str = "status_rank", ranks: int = len(STATUSES)
) -> DataFrame:
    """Per key the total and count of the best-ranked status that has rows, measured or not.

    Every status is totalled beside the others and one is picked at the end: a single
    exchange of partial totals, however many rows one key has.
    """

    def of(number: int) -> Column:
        return F.when(F.col(rank) == number, value)

    totals = [F.sum(of(number)).alias(f"_total_{number}") for number in range(ranks)]
    counts = [F.count(of(number)).alias(f"_count_{number}") for number in range(ranks)]
    grouped = readings.groupBy(*keys).agg(F.min(rank).alias(rank), *totals, *counts)

    def picked(prefix: str) -> Column:
        return F.get(F.array(*[F.col(f"{prefix}_{number}") for number in range(ranks)]), F.col(rank))

    return grouped.select(
        *keys, rank, picked("_total").alias("day_total"), picked("_count").alias("day_count")
    )


def merge_variables(long: DataFrame, keys: list[str], value: str = "value", buckets: int | None = None) -> DataFrame:
    """The same result as chained full outer joins, one per variable. Runs a job.

    The long frame is put in buckets of the keys by one exchange. Its distinct keys and each variable's rows are then joined where they lie. A full outer
    join would lose the placement, as its keys come from either side; left joins from the distinct keys keep it. Keys aren't null.
    """
    spark = long.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = bucketed_copy(long.select(*keys, "variable", value), keys, buckets, fresh_path(spark, "variables"))
    merged = placed.select(*keys).distinct()
    for variable, column in MEASURES.items():
        part = placed.where(F.col("variable") == variable).select(*keys, F.col(value).alias(column))
        merged = merged.join(part, keys, "left")
    return merged


def monthly_from_grid(
    grid: DataFrame,
    grain: Grain,
    crosswalk: DataFrame | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Daily grid rows to the monthly panel, with provenance when sources is given."""
    keyed = region_key(fold_month(grid), grain, crosswalk)
    panel = pivot_variables(keyed, [*grain.columns, "period_year", "period_month"])
    if sources is None:
        return panel
    return panel.join(sources, ["period_year", "period_month"], "left")
