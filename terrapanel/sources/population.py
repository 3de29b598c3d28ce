"""Two population sources of different shape, and how a newer one is chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.values import pad_key
from terrapanel.refdata import (
    DATE_CODE_FIRST,
    DATE_CODE_LAST,
    DATE_CODE_YEAR_ZERO,
    ESTIMATE_PREFIX,
    OLD_POPULATION_SOURCE,
    STATE_SUMMARY_LEVEL,
)


def read_json_matrix(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Documents holding one array of arrays each, the first inner array naming the columns."""
    documents = spark.read.text(paths, wholetext=True)
    matrix = documents.select(F.from_json("value", "array<array<string>>").alias("m"))
    rows = matrix.select(F.col("m")[0].alias("header"), F.posexplode("m").alias("pos", "cells"))

    def cell(name: str) -> Column:
        return F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1).alias(name)

    return rows.where("pos > 0").select(*[cell(name) for name in columns])


def decode_date_codes(
    df: DataFrame,
    year_zero: int = DATE_CODE_YEAR_ZERO,
    first: int = DATE_CODE_FIRST,
    last: int = DATE_CODE_LAST,
) -> DataFrame:
    """Keep the estimate codes and turn them into years."""
    code = F.col("DATE_CODE").cast("int")
    return df.where(code.between(first, last)).withColumn("period_year", code + year_zero)


def old_population(matrix: DataFrame, source: str = OLD_POPULATION_SOURCE, **codes: int) -> DataFrame:
    return decode_date_codes(matrix, **codes).select(
        pad_key(F.col("state"), 2).alias("state_fips"),
        "period_year",
        F.col("POP").cast("long").alias("population"),
        F.lit(source).alias("source"),
    )


def read_wide_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with a header, every column text."""
    return spark.read.csv(paths, header=True, inferSchema=False)


def state_level_only(df: DataFrame) -> DataFrame:
    return df.where(pad_key(F.col("SUMLEV"), 3) == STATE_SUMMARY_LEVEL)


def melt_years(df: DataFrame, ids: list[str], prefix: str = ESTIMATE_PREFIX) -> DataFrame:
    """Every column named prefix + year becomes rows (period_year, population)."""
    wide = [name for name in df.columns if name.startswith(prefix)]
    long = df.unpivot(ids, wide, "year_column", "population")
    year = F.regexp_replace("year_column", prefix, "").cast("int")
    return long.select(*ids, year.alias("period_year"), F.col("population").cast("long").alias("population"))


def new_population(wide: DataFrame, source: str) -> DataFrame:
    long = melt_years(state_level_only(wide), ["STATE"])
    return long.select(
        pad_key(F.col("STATE"), 2).alias("state_fips"),
        "period_year",
        "population",
        F.lit(source).alias("source"),
    )


def list_vintages(spark: SparkSession, root: str) -> DataFrame:
    """CSV files below root with the vintage their folder is named after. Contents are not opened."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(root)
    )
    vintage = F.regexp_extract("path", r"/(\d{4}-\d{4})/", 1)
    return listing.select("path", vintage.alias("vintage")).where(F.col("vintage") != "")


def read_newest(spark: SparkSession, root: str, candidates: list[str]) -> DataFrame:
    """Long population rows of the newest vintage present. Collects its file paths."""
    chosen = newest_vintage(list_vintages(spark, root), candidates).collect()
    return new_population(read_wide_csv(spark, [row.path for row in chosen]), chosen[0].vintage)


def newest_vintage(listing: DataFrame, candidates: list[str]) -> DataFrame:
    """From a listing with a vintage column keep the files of the first candidate present.

    candidates is newest first. Raises when the result is used and none is present.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("vintage"))
    ranked = listing.withColumn("vintage_rank", rank).where("vintage_rank > 0")
    best = ranked.agg(F.min("vintage_rank").alias("best")).select(
        F.when(F.col("best").isNull(), F.raise_error(F.lit("no population file of any known vintage")))
        .otherwise(F.col("best"))
        .cast("long")
        .alias("best")
    )
    return ranked.where(F.col("vintage_rank") == best.scalar()).drop("vintage_rank")
