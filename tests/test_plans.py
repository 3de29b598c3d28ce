"""Physical plans of registered queries: exchanges, scans, joins."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from helpers import exchanges, plan_of
from terrapanel.plans.counties import enrich_counties
from terrapanel.plans.overlays import align_overlay
from terrapanel.registry import QUERIES as PANEL_QUERIES
from terrapanel.schemas import GRID_SCHEMA
from terrapanel.sources import landed_grid

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "key, shuffles",
    [
        ("flagship_trend", 2),  # raw rows reduced, then one placement by region
        ("mart_annual", 2),
        ("annual_rollup", 2),
        ("seasonal_moving_average", 2),
        ("crosswalk_join", 1),
        ("latest_by_rank", 1),
        ("dedupe_keep_last", 1),
        ("monthly_from_daily", 1),
        ("daily_grid_scan_state", 0),
        ("baseline_join", 1),  # the baseline only; the stored panel stays put
    ],
)
def test_shuffle_budget(spark, key, shuffles):
    assert exchanges(queries()[key](spark, SF)) == shuffles


@pytest.mark.parametrize("key", sorted(PANEL_QUERIES))
def test_no_cross_join_and_no_python(spark, key):
    text = plan_of(queries()[key](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text


def test_only_used_columns_are_read(spark):
    text = plan_of(queries()["flagship_trend"](spark, SF))
    assert text.count("FileScan parquet") == 1
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    columns = {field.split(":")[0] for field in schema.split(",")}
    assert columns == {"l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate"}


@pytest.mark.parametrize("key", ["annual_map", "compare_years", "states_trend", "overlay_series", "period_summary"])
def test_reads_prune_partitions(spark, key):
    text = plan_of(queries()[key](spark, SF))
    filters = [part.split("]")[0] for part in text.split("PartitionFilters: [")[1:]]
    assert any("period_year" in found for found in filters)


def test_region_reads_push_the_region(spark):
    assert "EqualTo(state_abbr,GA)" in plan_of(queries()["state_trend"](spark, SF))
    assert "In(state_abbr, [" in plan_of(queries()["states_trend"](spark, SF))


def test_counties_without_a_name_are_kept(spark):
    rows = spark.createDataFrame([("01001", 1.0), ("99999", 2.0)], "fips_code string, prcp_in double")
    names = spark.createDataFrame(
        [("01001", "Autauga", "AL", 5.0)], "fips_code string, county_name string, state_abbr string, land_sq_mi double"
    )
    found = {r.fips_code: r.county_name for r in enrich_counties(rows, names).collect()}
    assert found == {"01001": "Autauga", "99999": None}


def test_overlay_values_come_from_one_dataset(spark):
    annual = spark.createDataFrame([("AL", 2000, 60.0)], "state_abbr string, period_year int, tavg_f double")
    rows = [("a", "01", "AL", 2000, 1.0), ("b", "01", "AL", 2000, 2.0), ("b", "01", "AL", 2000, 3.0)]
    overlay = spark.createDataFrame(
        rows, "dataset string, state_fips string, state_abbr string, period_year int, value double"
    )
    assert [r.overlay_value for r in align_overlay(annual, overlay, "a").collect()] == [1.0]
    with pytest.raises(Exception, match="b holds twice: AL 2000"):
        align_overlay(annual, overlay, "b").collect()


def test_landed_folders_are_pruned(spark, tmp_path):
    names = landed_grid.FOLDERS.fieldNames()
    keys = [("cty", y, m, v, s) for y in (1999, 2000) for m in (1, 2) for v in ("tmax", "prcp") for s in ("scaled", "prelim")]
    keys = [k for k in keys if not (k[1:4] == (2000, 2, "tmax") and k[4] == "scaled")] + [("ste", 2000, 1, "tmax", "odd")]
    rows = spark.createDataFrame(keys, landed_grid.FOLDERS)
    cells = {f: F.concat_ws(" ", F.lit(f), *names) for f in GRID_SCHEMA.fieldNames()}
    root = str(tmp_path / "landed")
    landed_grid.land(rows.withColumns(cells), root)
    assert landed_grid.partitions(spark, root).count() == len(keys)
    found = landed_grid.scan(spark, root, "cty", (2000, 2000), ["tmax"])
    kept = sorted((r.period_month, r.status) for r in found.collect())
    assert kept == [(1, "scaled"), (2, "prelim")]
    text = plan_of(found)
    filters = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(name in filters for name in ("period_year", "variable", "status")) and exchanges(found) == 0
    assert [r.status for r in landed_grid.scan(spark, root, "ste").collect()] == ["odd"]
