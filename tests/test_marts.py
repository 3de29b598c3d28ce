"""Baseline, anomaly, rollups, reads and series."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import exchanges, plan_of, rows
from terrapanel.operators import series
from terrapanel.plans import marts, overlays, queries

PANEL = "state_fips string, state_abbr string, period_year int, period_month int, tmax_f double, tmin_f double, tavg_f double, prcp_in double"


def panel(spark, cells):
    return spark.createDataFrame(
        [(f"{abbr}1", abbr, year, month, tavg, tavg, tavg, 1.0) for abbr, year, month, tavg in cells], PANEL
    )


def year_of(abbr, year, tavg, months=12):
    return [(abbr, year, month, tavg) for month in range(1, months + 1)]


def test_staging_drops_bad_rows(spark):
    raw = spark.createDataFrame(
        [("01", "AL", 1991, 1, 1.0, 1.0, 1.0, 1.0), (None, "AL", 1991, 1, 1.0, 1.0, 1.0, 1.0), ("01", "AL", 1991, 13, 1.0, 1.0, 1.0, 1.0)],
        PANEL,
    )
    staged = marts.stage_climate(raw)
    assert [str(r.period_date) for r in staged.collect()] == ["1991-01-01"]


def test_baseline_window_is_inclusive(spark):
    cells = [("AL", year, 1, value) for year, value in [(1990, 100.0), (1991, 1.0), (2020, 3.0), (2021, 100.0)]]
    staged = marts.stage_climate(panel(spark, cells))
    assert marts.baseline(staged).first().baseline_tavg_f == 2.0
    assert {r.baseline_tavg_f for r in marts.anomaly_by_region(staged).collect()} == {2.0}


@pytest.mark.parametrize("form", [marts.anomaly_by_region, marts.anomaly_by_region_join])
def test_same_calendar_month_only(spark, form):
    staged = marts.stage_climate(panel(spark, [("AL", 1991, 1, 10.0), ("AL", 1991, 7, 30.0), ("AL", 2021, 7, 33.0)]))
    found = {(r.period_year, r.period_month): r.anomaly_f for r in form(staged).collect()}
    assert found == {(1991, 1): 0.0, (1991, 7): 0.0, (2021, 7): 3.0}


@pytest.mark.parametrize("form", [marts.anomaly_by_region, marts.anomaly_by_region_join])
def test_baseline_of_nulls_only_counts_as_missing(spark, form):
    staged = marts.stage_climate(panel(spark, [("AL", 1991, 1, None), ("AL", 2021, 1, 5.0), ("AL", 2021, 2, 5.0)]))
    assert {(r.is_baseline_missing, r.anomaly_f) for r in form(staged).collect()} == {(True, None)}


def test_window_form_equals_join_form(spark):
    cells = [(a, y, m, float((y * 7 + m * 3 + len(a)) % 11)) for a in ("AL", "WY") for y in range(1989, 2023) for m in (1, 2, 12)]
    staged = marts.stage_climate(panel(spark, cells))
    keys = ["state_fips", "period_year", "period_month"]
    columns = [*keys, F.round("anomaly_f", 9), "is_baseline_missing"]
    one = rows(marts.anomaly_by_region(staged).select(*columns), *keys)
    assert one == rows(marts.anomaly_by_region_join(staged).select(*columns), *keys)


def test_annual_counts_unmeasured_months(spark):
    cells = [("AL", 2000, m, None if m <= 3 else 50.0) for m in range(1, 13)] + year_of("AL", 2001, 50.0)
    cells += year_of("AL", 2002, 60.0, 5)
    annual = marts.mart_annual(marts.anomaly_by_region(marts.stage_climate(panel(spark, cells))))
    found = {r.period_year: r for r in annual.collect()}
    assert (found[2000].months_reported, found[2000].is_partial_year, found[2000].has_data_gap) == (12, False, False)
    assert found[2000].tavg_f == 50.0 and found[2000].prcp_in == 12.0
    assert (found[2002].months_reported, found[2002].is_partial_year) == (5, True)


def test_annual_anomaly_is_the_mean_of_monthly_ones(spark):
    cells = year_of("AL", 1991, 50.0) + [("AL", 2021, 1, 53.0), ("AL", 2021, 2, 51.0)]
    annual = marts.mart_annual(marts.anomaly_by_region(marts.stage_climate(panel(spark, cells))))
    assert {r.period_year: r.anomaly_f for r in annual.collect()}[2021] == 2.0


def test_monthly_and_annual_gap_flags_differ(spark):
    anomalies = marts.anomaly_by_region(marts.stage_climate(panel(spark, [("AL", 1991, 1, 1.0), ("AL", 1992, 1, None)])))
    monthly = {r.period_year: r.has_data_gap for r in marts.mart_monthly(anomalies).collect()}
    annual = {r.period_year: r.has_data_gap for r in marts.mart_annual(anomalies).collect()}
    assert monthly == {1991: False, 1992: True} and annual == {1991: False, 1992: False}


@pytest.fixture
def monthly(spark):
    """AL: all of 1991, March missing in 2001 which ends in July; WY: no row in 1991; DE: only 2005."""
    cells = year_of("AL", 1991, 10.0) + [("AL", 2001, m, 10.0 + m) for m in (1, 2, 4, 5, 6, 7)]
    cells += year_of("WY", 1995, 20.0) + [("WY", 2001, 7, 25.0)]
    return marts.mart_monthly(marts.anomaly_by_region(marts.stage_climate(panel(spark, cells)), 1991, 1995))


def test_period_summary(monthly):
    found = {r.state_abbr: r for r in queries.period_summary(monthly, 1991).collect()}
    assert {r.months_compared for r in found.values()} == {7}
    assert {r.end_year for r in found.values()} == {2001}
    assert found["AL"].change_f == pytest.approx((1 + 2 + 4 + 5 + 6 + 7) / 6)
    assert found["WY"].change_f is None and found["WY"].avg_tavg_f == pytest.approx((12 * 20 + 25) / 13)


def test_period_summary_equals_its_parts(monthly):
    parts = queries.year_anomalies(monthly, 1991)
    by_year = {(r.state_abbr, r.period_year): r.anomaly_f for r in parts.collect()}
    means = {r.state_abbr: r.avg_tavg_f for r in queries.average_temperature(monthly, 1991).collect()}
    for row in queries.period_summary(monthly, 1991).collect():
        first, last = by_year.get((row.state_abbr, 1991)), by_year.get((row.state_abbr, 2001))
        change = None if first is None or last is None else last - first
        assert (row.change_f, row.avg_tavg_f) == (pytest.approx(change), means[row.state_abbr])


def test_an_unloaded_year_is_an_error(monthly):
    with pytest.raises(Exception, match="no rows for the year 2050"):
        queries.period_summary(monthly, 1991, 2050).collect()
    with pytest.raises(Exception, match="no rows for the year 2050"):
        queries.latest_month(monthly, 2050).collect()


def test_period_map_notes_a_partial_comparison(monthly):
    summary = queries.period_summary(monthly, 1991)
    assert {r.is_partial_comparison for r in queries.period_map_series(summary).collect()} == {True}
    assert {r.is_partial_comparison for r in queries.period_map_series(summary, "avg").collect()} == {False}


def test_compare_one_year_with_itself(monthly):
    annual = marts.mart_annual(monthly)
    both = queries.compare_years(annual, 2001, 2001)
    assert sorted((r.side, r.state_abbr) for r in both.collect()) == [
        ("end", "AL"), ("end", "WY"), ("start", "AL"), ("start", "WY"),
    ]


def test_requested_regions_keep_their_order(monthly):
    annual = marts.mart_annual(monthly)
    nested = queries.nested_by_request(annual, "wy, XX,al", ["tavg_f"]).collect()
    assert [(r.state_abbr, [p.period_year for p in r.series]) for r in nested] == [
        ("WY", [1995, 2001]),
        ("XX", []),
        ("AL", [1991, 2001]),
    ]


def test_regions_from_a_frame(spark, monthly):
    ids = spark.createDataFrame([("WY",), ("XX",)], "state_abbr string")
    assert {r.state_abbr for r in queries.in_regions(monthly, ids).collect()} == {"WY"}
    assert {r.state_abbr for r in queries.in_regions(monthly, ["AL"]).collect()} == {"AL"}


def test_request_checks(monthly):
    with pytest.raises(ValueError):
        queries.requested_ids(" , ")
    with pytest.raises(ValueError):
        queries.requested_ids("a,b,c,d,e,f", 5)
    assert len(queries.requested_ids("a,b,c,d,e,f")) == 6
    with pytest.raises(ValueError):
        queries.month_drilldown(monthly, "AL", 13)
    with pytest.raises(queries.UnknownOverlay):
        queries.live_overlay("nothing")
    with pytest.raises(queries.OverlayNotReady):
        queries.live_overlay("fbi_crime")


def values_of(spark, numbers, column, years=None):
    years = years or range(2000, 2000 + len(numbers))
    df = spark.createDataFrame(list(zip(["a"] * len(numbers), years, numbers)), "r string, period_year int, v double")
    return [r[0] for r in df.withColumn("x", column).orderBy("period_year").select("x").collect()]


@pytest.mark.parametrize(
    "numbers, window, smooth",
    [
        ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 5, [2.0, 2.5, 3.0, 4.0, 4.5, 5.0]),
        ([1.0], 5, [1.0]),
        ([1.0, 3.0], 5, [2.0, 2.0]),
        ([1.0, None, 5.0], 3, [1.0, 3.0, 5.0]),
        ([None, None], 5, [None, None]),
        ([1.0, float("nan"), 5.0], 3, [1.0, 3.0, 5.0]),
        ([1.0, 2.0, 3.0, 4.0], 2, [1.5, 2.0, 3.0, 3.5]),
        ([1.0, 2.0, 3.0], 1, [1.0, 2.0, 3.0]),
    ],
)
def test_moving_average(spark, numbers, window, smooth):
    assert values_of(spark, numbers, series.moving_average("v", ["r"], window=window)) == smooth


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=9), st.integers(1, 7))
def test_moving_average_against_brute_force(spark, numbers, window):
    half = window // 2
    around = [[v for v in numbers[max(0, i - half) : i + half + 1] if v is not None] for i in range(len(numbers))]
    wanted = [sum(part) / len(part) if part else None for part in around]
    assert values_of(spark, numbers, series.moving_average("v", ["r"], window=window)) == pytest.approx(wanted)


def test_moving_average_counts_rows_not_years(spark):
    found = values_of(spark, [1.0, 2.0, 3.0], series.moving_average("v", ["r"], window=3), [1990, 2000, 2010])
    assert found == [1.5, 2.0, 2.5]


@pytest.mark.parametrize(
    "numbers, change",
    [
        ([10.0, 15.0, 5.0], [0.0, 50.0, -50.0]),
        ([0.0, 5.0], [None, None]),
        ([None, 5.0], [None, None]),
        ([10.0, None], [0.0, None]),
    ],
)
def test_percent_from_start(spark, numbers, change):
    assert values_of(spark, numbers, series.percent_from_start("v", ["r"])) == pytest.approx(change)


def test_trend_chart_filters_before_it_smooths(spark, monthly):
    cells = [c for year in range(1991, 2001) for c in year_of("AL", year, float(year))]
    annual = marts.mart_annual(marts.anomaly_by_region(marts.stage_climate(panel(spark, cells)), 1991, 1991))
    people = spark.createDataFrame(
        [("census_population", "AL1", "AL", y, float(y - 1980)) for y in (1994, 1995, 1996)],
        "dataset string, state_fips string, state_abbr string, period_year int, value double",
    )
    lines = queries.trend_chart_series(annual, "AL", 1995, 1999, "tavg_f", people)
    found = {(r.line, r.period_year): r.value for r in lines.collect()}
    assert found["climate", 1995] == pytest.approx(1996.0)  # 1995-1997, not 1993-1997
    assert found["overlay", 1995] == 0.0 and found["overlay", 1996] == pytest.approx(100 / 15)
    assert ("overlay", 1997) not in found


@pytest.mark.parametrize(
    "pairs, r, years",
    [
        ([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], 1.0, 3),
        ([(1.0, 5.0), (2.0, 5.0)], None, 2),
        ([(1.0, 5.0)], None, 1),
        ([(1.0, 3.0), (2.0, 2.0), (3.0, None)], -1.0, 2),
    ],
)
def test_correlation(spark, pairs, r, years):
    long = [
        (dataset, "01", "AL", 2000 + i, value)
        for i, pair in enumerate(pairs)
        for dataset, value in zip(("a", "b"), pair)
    ]
    df = spark.createDataFrame(long, "dataset string, state_fips string, state_abbr string, period_year int, value double")
    row = queries.correlation(df, "a", "b", "al").first()
    assert (row.pearson_r, row.years) == (pytest.approx(r), years)


def test_per_capita_without_people(spark):
    overlay = spark.createDataFrame([("d", "01", "AL", 2000, 10.0), ("d", "02", "AZ", 2000, 10.0), ("d", "04", "AR", 2000, 10.0)],
                                    "dataset string, state_fips string, state_abbr string, period_year int, value double")
    people = spark.createDataFrame([("01", 2000, 5), ("02", 2000, 0)], "state_fips string, period_year int, population long")
    found = rows(overlays.per_capita(overlay, people, 100).select("state_fips", "per_capita"), "state_fips")
    assert found == [("01", 200.0), ("02", None), ("04", None)]


def test_shuffle_budget(spark):
    """Placed by region once, the anomaly, the rollup and the series share that exchange."""
    staged = marts.stage_climate(panel(spark, year_of("AL", 1991, 1.0)))
    assert exchanges(marts.anomaly_by_region(staged)) == 1
    annual = marts.mart_annual(marts.anomaly_by_region(staged))
    assert exchanges(annual) == 1
    assert exchanges(queries.flagship_trend(annual)) == 1


def test_join_form_does_not_shuffle_a_stored_panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, year_of("AL", 1991, 1.0) + year_of("AL", 2021, 2.0)).write.partitionBy("period_year").parquet(path)
    joined = marts.anomaly_by_region_join(marts.stage_climate(spark.read.parquet(path)))
    text = plan_of(joined)
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1
    assert "period_year#" in text and "PartitionFilters: [isnotnull(period_year" in text


def test_region_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, year_of("AL", 1991, 1.0)).write.parquet(path)
    annual = marts.mart_annual(marts.anomaly_by_region(marts.stage_climate(spark.read.parquet(path))))
    text = plan_of(annual.where("state_fips = 'AL1'"))
    assert "EqualTo(state_fips,AL1)" in text
