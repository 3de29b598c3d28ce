"""Grid files: names, status choice, ragged months, folding, merging, provenance."""

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, plan_of, rows
from terrapanel.operators import cleaning
from terrapanel.schemas import COUNTY, STATE
from terrapanel.sources import daily_grid as grid
from terrapanel.sources.regions import crosswalk


def line(code, days, kind="ste", year=1900, month=1, variable="ignored"):
    return ",".join([kind, code, "XX: Name", str(year), str(month), variable, *[str(d) for d in days]])


def write(root, name, *lines):
    (root / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def landing(tmp_path):
    write(tmp_path, "tmax-199901-ste-scaled.csv", line("01", [" 10.0"] * 31), line("02", [" -999.99"] * 31))
    write(tmp_path, "tmax-199901-ste-prelim.csv", line("01", [" 99.0"] * 31))
    write(tmp_path, "tmin-199902-ste-prelim.csv", line("03", ["1"] * 27 + ["-900"]), line("60", ["1"] * 28))
    write(tmp_path, "tavg-199901-ste-scaled.csv", line("01", [5] * 30 + ["abc"]))
    write(tmp_path, "prcp-199901-ste-scaled.csv", line("02", ["-999.99"] * 31), line("48", [25.4] * 31))
    write(tmp_path, "prcp-199901-cty-scaled.csv", line("1001", [25.4], "cty"))
    write(tmp_path, "readme.csv", "not a grid file")
    return tmp_path


def test_name_tells_period_and_status(spark, landing):
    files = grid.list_files(spark, str(landing))
    found = rows(files.select("variable", "period_year", "period_month", "scale", "status", "status_rank"), "file_name")
    assert len(found) == 6
    assert ("tmin", 1999, 2, "ste", "prelim", 1) in found
    assert ("prcp", 1999, 1, "cty", "scaled", 0) in found


@pytest.mark.parametrize(
    "present, kept",
    [({"scaled"}, "scaled"), ({"prelim"}, "prelim"), ({"scaled", "prelim"}, "scaled")],
)
def test_status_preference(spark, present, kept):
    names = [f"/x/tmax-199901-ste-{status}.csv" for status in present]
    files = grid.with_file_tags(spark.createDataFrame([(n,) for n in names], "path string"))
    assert [r.status for r in grid.prefer_status(files).collect()] == [kept]


def test_status_is_chosen_per_variable_and_month(spark):
    names = ["tmax-199901-ste-scaled.csv", "tmin-199901-ste-prelim.csv", "tmax-199902-ste-prelim.csv"]
    files = grid.with_file_tags(spark.createDataFrame([(n,) for n in names], "path string"))
    assert grid.prefer_status(files).count() == 3


def test_part_files_of_one_folder_are_all_kept(spark):
    names = [f"/x/file=tmax-199901-ste-scaled.csv/part-{i}.csv" for i in range(3)]
    files = grid.with_file_tags(spark.createDataFrame([(n,) for n in names], "path string"))
    assert grid.prefer_status(files).count() == 3


def test_monthly_panel(spark, landing):
    scanned = grid.scan_grid(spark, str(landing), "ste")
    panel = cleaning.monthly_from_grid(scanned, STATE, crosswalk(spark))
    found = {(r.state_abbr, r.period_month): r for r in panel.collect()}
    assert set(found) == {("AL", 1), ("AZ", 1), ("AR", 2), ("WY", 1)}
    alabama = found["AL", 1]
    assert alabama.tmax_f == 50.0  # the preliminary 99 was not read
    assert alabama.tavg_f == 41.0  # the bad cell is skipped
    assert alabama.prcp_in is None and alabama.tmin_f is None
    arizona = found["AZ", 1]  # all markers: the row stays, without values, rain not zero
    assert (arizona.tmax_f, arizona.prcp_in) == (None, None)
    assert found["AR", 2].tmin_f == 33.8  # 28 columns, the last one a marker
    assert found["WY", 1].prcp_in == pytest.approx(31.0)
    assert alabama.period_year == 1999  # from the name, the columns say 1900


def test_county_panel_pads_its_code(spark, landing):
    scanned = grid.scan_grid(spark, str(landing), "cty")
    (row,) = cleaning.monthly_from_grid(scanned, COUNTY).collect()
    assert (row.fips_code, row.prcp_in) == ("01001", 1.0)


def test_unmapped_rows_are_reported(spark, landing):
    scanned = grid.scan_grid(spark, str(landing), "ste")
    assert [r.region_code for r in cleaning.unmapped(scanned, crosswalk(spark)).collect()] == ["60"]


@pytest.mark.parametrize("days", [28, 29, 30, 31])
def test_ragged_months(spark, tmp_path, days):
    write(tmp_path, "prcp-199902-cty-scaled.csv", line("1", [2] * days), line("2", [" "] * days))
    folded = cleaning.fold_days(grid.scan_grid(spark, str(tmp_path), "cty"))
    assert rows(folded.select("region_code", "day_total", "day_count"), "region_code") == [
        ("1", 2.0 * days, days),
        ("2", 0.0, 0),
    ]


def test_no_files_gives_an_empty_grid(spark, landing):
    files = grid.list_files(spark, str(landing)).where("period_year = 1800")
    assert grid.read_files(spark, files).count() == 0


def test_provenance_follows_variable_order(spark, landing):
    files = grid.prefer_status(grid.list_files(spark, str(landing)).where("scale = 'ste'"))
    sources = {r.period_month: r.source_file for r in grid.provenance(files, "file_name").collect()}
    assert sources[1] == "tmax-199901-ste-scaled.csv;tavg-199901-ste-scaled.csv;prcp-199901-ste-scaled.csv"
    assert sources[2] == "tmin-199902-ste-prelim.csv"


def test_pivot_equals_outer_joins(spark):
    long = spark.createDataFrame(
        [("a", "tmax", 1.0), ("a", "prcp", 2.0), ("b", "tmin", 3.0), ("c", "tavg", None)],
        "k string, variable string, value double",
    )
    wide = rows(cleaning.pivot_variables(long, ["k"]), "k")
    assert wide == rows(cleaning.merge_variables(long, ["k"]), "k")
    assert wide == [("a", 1.0, None, None, 2.0), ("b", None, 3.0, None, None), ("c", None, None, None, None)]


def test_a_cell_given_twice_is_an_error(spark):
    long = spark.createDataFrame(
        [("a", "tmax", 10.0), ("a", "tmax", 20.0)], "k string, variable string, value double"
    )
    with pytest.raises(Exception, match="several rows of tmax for a"):
        cleaning.pivot_variables(long, ["k"]).collect()


def test_an_unknown_status_ranks_last(spark):
    ranks = spark.createDataFrame([("scaled",), ("prelim",), ("draft",), (None,)], "s string")
    assert [r[0] for r in ranks.select(grid.status_rank(F.col("s"))).collect()] == [0, 1, 2, 2]


def test_month_spine_stops_at_the_current_month(spark):
    def months(start, end, as_of):
        spine = grid.month_spine(spark.range(1), F.lit(start), F.lit(end), F.lit(as_of).cast("date"))
        return rows(spine, "period_year", "period_month")

    assert len(months(1991, 1992, "2000-01-15")) == 24
    assert months(1999, 2000, "2000-02-29")[-1] == (2000, 2)
    assert months(2001, 2002, "2000-02-29") == []


def test_skipped_months(spark, landing):
    spine = grid.month_spine(spark.range(1), F.lit(1999), F.lit(1999), F.lit("1999-03-31").cast("date"))
    assert rows(grid.months_without_files(spine, grid.list_files(spark, str(landing)))) == [(1999, 3)]


def test_refresh_scope(spark):
    names = [f"tmax-{year}01-ste-scaled.csv" for year in (1998, 1999, 2000, 2001)]
    files = grid.with_file_tags(spark.createDataFrame([(n,) for n in names], "path string"))
    kept = grid.in_refresh_scope(files, F.lit("2000-06-01").cast("date"))
    assert sorted(r.period_year for r in kept.collect()) == [1999, 2000]


def test_probe(spark):
    names = [f"tavg-{period}-ste-prelim.csv" for period in (200011, 200012)] + ["tmax-200011-ste-prelim.csv"]
    files = grid.with_file_tags(spark.createDataFrame([(n,) for n in names], "path string"))
    probed = grid.probe_files(files, F.lit("2001-01-15").cast("date"))
    assert [r.file_name for r in probed.collect()] == [names[0]]


def test_profile(spark, landing):
    lines = spark.read.text(str(landing / "tmin-199902-ste-prelim.csv"))
    row = grid.profile_source(lines, crosswalk(spark)).first()
    assert (row.row_count, row.min_columns, row.max_columns, row.codes, row.unmapped_codes) == (2, 34, 34, 2, 1)


def test_best_status_totals(spark):
    readings = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 50.0), ("b", 1, 7.0), ("c", 0, None), ("c", 1, 9.0)],
        "k string, status_rank int, v double",
    )
    best = cleaning.totals_of_best_status(readings, ["k"], F.col("v"))
    assert exchanges(best) == 1
    assert rows(best, "k") == [("a", 0, 3.0, 2), ("b", 1, 7.0, 1), ("c", 0, None, 0)]


def test_fold_needs_no_shuffle(spark, landing):
    scanned = grid.scan_grid(spark, str(landing), "ste")
    assert exchanges(cleaning.fold_month(scanned)) == 0
    panel = cleaning.monthly_from_grid(scanned, STATE, crosswalk(spark))
    assert exchanges(panel) == 1 and "BroadcastHashJoin" in plan_of(panel)


def test_a_large_crosswalk_is_not_broadcast(spark, landing):
    """No hint forces it: beyond Spark's threshold the join falls back to a shuffle."""
    scanned = grid.scan_grid(spark, str(landing), "ste")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        panel = cleaning.monthly_from_grid(scanned, STATE, crosswalk(spark))
        assert "BroadcastHashJoin" not in plan_of(panel) and panel.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
