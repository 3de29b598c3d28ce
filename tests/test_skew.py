"""One supplier, customer and user hold a third of all rows, and a third of all rows are copies of one."""

import shutil

import pytest
from pyspark.sql import functions as F

from sqltwin import TABLES, assert_agrees, connect

SF = "/root/testdata/sf0.001"
HOT = {"lineitem": ("l_suppkey", 3), "orders": ("o_custkey", 7), "events": ("user_id", 11)}
KEYS = [
    "flagship_trend", "annual_rollup", "baseline_join", "period_summary", "latest_by_rank", "missing_variable_fill",
    "county_enrich", "population_long", "dedupe_keep_last", "correlation", "unmapped_report", "monthly_from_daily",
    "monthly_from_daily_county", "upsert_climate_county", "prelim_to_scaled_revision", "unique_key", "arrival_stream",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        target = str(root / f"{name}.parquet")
        if name not in HOT:
            shutil.copy(f"{SF}/{name}.parquet", target)
            continue
        column, value = HOT[name]
        table = spark.read.parquet(f"{SF}/{name}.parquet").withColumn("_n", F.monotonically_increasing_id())
        hot = table.withColumn(column, F.when(F.col("_n") % 3 == 0, F.lit(value).cast("long")).otherwise(F.col(column)))
        copies = table.where("_n = 1").drop("_n").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_")
        # DuckDB reads one file per table
        hot.drop("_n").unionByName(copies).toPandas().to_parquet(target, coerce_timestamps="us")
    return str(root)


@pytest.fixture(scope="module")
def db(skewed):
    return connect(skewed)


@pytest.mark.parametrize("key", KEYS)
def test_agrees_with_sql_under_skew(spark, db, skewed, key):
    assert_agrees(spark, db, skewed, key)
