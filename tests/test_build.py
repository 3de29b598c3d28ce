"""Landing files to raw tables to marts to reads, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from terrapanel.plans import queries
from terrapanel.plans.build import build_marts
from terrapanel.plans.checks import model_checks
from terrapanel.schemas import COUNTY
from terrapanel.sources import population as sources
from terrapanel.streaming import refresh


@pytest.fixture
def landing(tmp_path):
    grid = tmp_path / "grid"
    grid.mkdir()
    for year in (1999, 2000):
        for month in range(1, 13 if year == 1999 else 4):
            for variable, value in (("tavg", month + (year - 1999)), ("prcp", 25.4)):
                lines = [f"ste,{code},X,{year},{month},{variable}," + ",".join([str(value)] * 28) for code in ("01", "02", "49")]
                (grid / f"{variable}-{year}{month:02d}-ste-scaled.csv").write_text("\n".join(lines) + "\n")
    people = [["NAME", "POP", "DATE_CODE", "state"], ["Alabama", "10", "3", "1"], ["Alabama", "20", "4", "1"]]
    (tmp_path / "old.json").write_text(json.dumps(people))
    (tmp_path / "new.csv").write_text("SUMLEV,STATE,POPESTIMATE2011,POPESTIMATE2012\n40,01,25,30\n10,00,900,900\n")
    return tmp_path


def test_end_to_end(spark, landing):
    root = str(landing)
    today = F.lit("2000-03-31").cast("date")
    refresh.refresh(spark, f"{root}/grid", f"{root}/raw/climate", today)
    matrix = sources.read_json_matrix(spark, f"{root}/old.json", ["POP", "DATE_CODE", "state"])
    wide = sources.read_wide_csv(spark, f"{root}/new.csv")
    refresh.refresh_population(
        sources.old_population(matrix), sources.new_population(wide, "new"), f"{root}/raw/population", today
    )
    raw, people = spark.read.parquet(f"{root}/raw/climate"), spark.read.parquet(f"{root}/raw/population")
    assert raw.count() == 2 * 15
    stored = build_marts(raw, people, f"{root}/marts", 1999, 1999)

    (al, az) = queries.annual_map(stored["mart_annual"], 2000).orderBy("state_abbr").collect()
    assert (al.state_abbr, az.state_abbr) == ("AL", "AZ")
    assert al.anomaly_f == pytest.approx(1.8) and al.prcp_in == pytest.approx(3 * 28.0)
    assert (al.months_reported, al.is_partial_year, al.has_data_gap) == (3, True, False)
    (summary, _) = queries.period_summary(stored["mart_monthly"], 1999).orderBy("state_abbr").collect()
    assert (summary.months_compared, summary.end_year) == (3, 2000)
    assert summary.change_f == pytest.approx(1.8)
    overlay = queries.overlay_series(stored["mart_overlay"], "census_population", "al").collect()
    assert [(r.period_year, r.value) for r in overlay] == [(2010, 10.0), (2011, 25.0), (2012, 30.0)]
    assert model_checks(stored).where("failing_rows > 0").count() == 0


def test_rebuilding_drops_years_no_longer_there(spark, landing):
    root = str(landing)
    refresh.refresh(spark, f"{root}/grid", f"{root}/raw", F.lit("2000-03-31").cast("date"))
    people = spark.createDataFrame([("01", "AL", 2010, 1, "s")], "state_fips string, state_abbr string, period_year int, population long, source string")
    raw = spark.read.parquet(f"{root}/raw")
    build_marts(raw, people, f"{root}/marts", 1999, 1999)
    rebuilt = build_marts(raw.where("period_year = 1999"), people, f"{root}/marts", 1999, 1999)
    assert [r[0] for r in rebuilt["mart_annual"].select("period_year").distinct().collect()] == [1999]


def test_county_marts_and_reads(spark, tmp_path):
    grid = tmp_path / "grid"
    grid.mkdir()
    for year in (1999, 2000):
        lines = [f"cty,{code},X,{year},1,tavg," + ",".join([str(year - 1999 + 10)] * 28) for code in ("1001", "13121")]
        (grid / f"tavg-{year}01-cty-scaled.csv").write_text("\n".join(lines) + "\n")
    report = refresh.backfill(spark, str(grid), f"{tmp_path}/raw", 1999, 2000, F.lit("2000-01-31").cast("date"), COUNTY)
    assert report.where("item = 'rows written'").first().n == 4
    stored = build_marts(spark.read.parquet(f"{tmp_path}/raw"), None, f"{tmp_path}/marts", 1999, 1999, grain=COUNTY)
    assert set(stored) == {"mart_monthly", "mart_annual"}
    rows = queries.state_trend(stored["mart_annual"], "01001", 1999, grain=COUNTY).collect()
    assert [(r.fips_code, r.period_year, round(r.anomaly_f, 6)) for r in rows] == [("01001", 1999, 0), ("01001", 2000, 1.8)]
    summary = queries.period_summary(stored["mart_monthly"], 1999, grain=COUNTY).collect()
    assert {(r.fips_code, round(r.change_f, 6)) for r in summary} == {("01001", 1.8), ("13121", 1.8)}
    assert queries.month_drilldown(stored["mart_monthly"], "13121", 1, COUNTY).count() == 2
    assert queries.annual_map(stored["mart_annual"], 2000, COUNTY).count() == 2
