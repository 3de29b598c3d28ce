"""Population: both sources to one annual panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_sources(*sources: DataFrame) -> DataFrame:
    """Union in order of trust: a later source outranks an earlier one."""
    ranked = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def _best(stacked: DataFrame, keys: list[str], rank: str) -> tuple[DataFrame, Column, list[str]]:
    """Per key the row of the highest rank, whether that rank has two rows with different values, and the value columns.

    Largest and smallest values of the highest rank come from one aggregate: copies of one key collapse before the shuffle. Of
    rows in that rank the one is the maximum by (rank, values), the other the minimum by (-rank, values).
    """
    values = [name for name in stacked.columns if name not in (*keys, rank)]
    held = F.struct(*values)
    grouped = stacked.groupBy(*keys).agg(
        F.max(F.struct(F.col(rank).alias("rank"), held.alias("row"))).alias("best"),
        F.min(F.struct((-F.col(rank)).alias("rank"), held.alias("row"))).alias("other"),
    )
    return grouped, ~F.col("best.row").eqNullSafe(F.col("other.row")), values


def keep_last(stacked: DataFrame, keys: list[str], rank: str = "source_rank", refuse_clashes: bool = False) -> DataFrame:
    """The row of the highest rank per key; equal rows are copies. Of different rows that one source has for one key, whose order says
    nothing, the one with larger values is taken, or the plan fails when it runs. `source_clashes` lists such keys."""
    grouped, clash, values = _best(stacked, keys, rank)
    if not refuse_clashes:
        return grouped.select(*keys, *[f"best.row.{name}" for name in values])
    shown = [F.coalesce(F.col(key).cast("string"), F.lit("null")) for key in keys]
    message = F.concat_ws(" ", F.lit("one source has different rows for"), *shown)
    kept = F.when(clash, F.raise_error(message).cast(grouped.schema["best"].dataType["row"].dataType)).otherwise(F.col("best.row"))
    return grouped.select(*keys, kept.alias("row")).select(*keys, *[f"row.{name}" for name in values])


def source_clashes(stacked: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Keys for which the source that would win has different rows: (keys, rank, smallest and largest values as text)."""
    grouped, clash, _ = _best(stacked, keys, rank)
    return grouped.where(clash).select(
        *keys,
        F.col("best.rank").alias(rank),
        F.to_json("other.row").alias("one"),
        F.to_json("best.row").alias("another"),
    )


def in_scope(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Only the listed states."""
    return df.join(lookup.select("state_fips"), "state_fips", "left_semi")


def add_abbreviation(df: DataFrame, lookup: DataFrame) -> DataFrame:
    return df.join(lookup, "state_fips")


def population_long(old: DataFrame, new: DataFrame, lookup: DataFrame) -> DataFrame:
    """Older and newer source to one row per state and year, the newer one winning. Fails if that source contradicts itself."""
    stacked = in_scope(stack_sources(old, new), lookup)
    annual = keep_last(stacked, ["state_fips", "period_year"], refuse_clashes=True)
    return add_abbreviation(annual, lookup).select(
        "state_fips", "state_abbr", "period_year", "population", "source"
    )
