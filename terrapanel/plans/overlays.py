"""The long overlay table and what is computed across its datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.series import correlation_of

REGION_YEAR = ["state_fips", "state_abbr", "period_year"]


def overlay_branch(df: DataFrame, dataset: str, value: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), *REGION_YEAR, value.cast("double").alias("value"))


def mart_overlay(*branches: DataFrame) -> DataFrame:
    """One row per dataset, region and year; a new dataset is one more branch."""
    return reduce(DataFrame.unionByName, branches)


def population_overlay(staged_population: DataFrame) -> DataFrame:
    return overlay_branch(staged_population, "census_population", F.col("population"))


def align_overlay(annual: DataFrame, overlay: DataFrame, dataset: str) -> DataFrame:
    """One dataset's values next to the climate rows of the same region and year, null where it has none.

    A region-year the dataset holds twice fails when the plan runs.
    """
    twice = F.raise_error(F.concat_ws(" ", F.lit(f"{dataset} holds twice:"), "state_abbr", "period_year")).cast("double")
    values = (
        overlay.where(F.col("dataset") == dataset)
        .groupBy("state_abbr", "period_year")
        .agg(F.count("*").alias("n"), F.max("value").alias("value"))
        .select(
            "state_abbr", "period_year", F.when(F.col("n") > 1, twice).otherwise(F.col("value")).alias("overlay_value")
        )
    )
    return annual.join(values, ["state_abbr", "period_year"], "left")


def per_capita(overlay: DataFrame, population: DataFrame, per: float = 1.0) -> DataFrame:
    """Overlay values per so many people; null without a population or with none living there."""
    people = population.select("state_fips", "period_year", "population")
    joined = overlay.join(people, ["state_fips", "period_year"], "left")
    return joined.withColumn("per_capita", F.try_divide("value", "population") * per)


def correlate(overlay: DataFrame, dataset_a: str, dataset_b: str) -> DataFrame:
    """Pearson r between two datasets per region, over the years both have.

    The years are paired by a conditional aggregate, so both datasets are read in one pass.
    """

    def side(dataset: str, name: str) -> Column:
        return F.max(F.when(F.col("dataset") == dataset, F.col("value"))).alias(name)

    pairs = (
        overlay.where(F.col("dataset").isin(dataset_a, dataset_b))
        .groupBy("state_abbr", "period_year")
        .agg(side(dataset_a, "a"), side(dataset_b, "b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    return pairs.groupBy("state_abbr").agg(
        correlation_of(F.col("a"), F.col("b")).alias("pearson_r"), F.count("*").alias("years")
    )
