"""Cleaning, joins, aggregates and models on the monthly panel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrapanel.functions import values
from terrapanel.operators import cleaning, series
from terrapanel.operators.tables import YearTable
from terrapanel.plans import marts, queries
from terrapanel.plans.baselines import baseline_of_parts, baseline_parts, parts_table
from terrapanel.plans.build import refresh_marts
from terrapanel.registry import models
from terrapanel.registry.base import (
    ANNUAL_VALUES,
    BASE_END,
    BASE_START,
    END,
    MEASURE_COLUMNS,
    SQL_ANNUAL,
    SQL_MEASURES,
    SQL_MONTHLY,
    START,
    register,
    rounded,
    sql,
    sql_pad,
    sql_r8,
)
from terrapanel.schemas import ANNUAL_COLUMNS, COUNTY, MONTHLY_COLUMNS, STATE
from terrapanel.session import fresh_path
from terrapanel.session import staged as at_rest
from terrapanel.sources import sample_tables as sample
from terrapanel.plans.counties import enrich_counties
from terrapanel.sources.regions import county_dimension, crosswalk

MONTH = ["period_year", "period_month"]
SQL_REGION_MONTH = "state_fips, state_abbr, period_year, period_month"

# ---- scalar rules ----------------------------------------------------------


@register(
    "numeric_coerce",
    """SELECT l_linenumber, count(*) AS texts, count(*) FILTER (l_linenumber IN (1, 2)) AS parsed,
              CASE WHEN l_linenumber = 1 THEN sum(l_quantity) WHEN l_linenumber = 2 THEN sum(l_quantity * 10)
              END AS total
       FROM lineitem GROUP BY l_linenumber""",
)
def numeric_coerce(spark, sf):
    quantity = F.col("l_quantity").cast("string")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.lit(" "), quantity, F.lit(" ")))
        .when(line == 2, F.concat(quantity, F.lit("e1")))
        .when(line == 3, F.concat(quantity, F.lit("d")))
        .when(line == 4, F.lit("NaN"))
        .when(line == 5, F.concat(F.lit("q"), quantity))
        .when(line == 6, F.lit("inf"))
        .otherwise(F.lit(""))
    )
    parsed = sample.table(spark, sf, "lineitem").select("l_linenumber", values.to_number(text).alias("x"))
    return parsed.groupBy("l_linenumber").agg(
        F.count("*").alias("texts"), F.count("x").alias("parsed"), F.sum("x").alias("total")
    )


@register(
    "sentinel_mask",
    sql(
        """SELECT fips_code, variable, count(*) AS readings, count(present) AS present_readings,
                  sum(present) AS present_total FROM obs GROUP BY ALL""",
        "obs",
    ),
)
def sentinel_mask(spark, sf):
    present = values.drop_missing(F.col("reading"))
    counts = sample.readings(spark, sf, COUNTY).groupBy("region_number", "variable_number").agg(
        F.count("*").alias("readings"),
        F.count(present).alias("present_readings"),
        F.sum(present).alias("present_total"),
    )
    return sample.named(counts, COUNTY).withColumnRenamed("region_code", "fips_code")


@register(
    "unit_convert",
    sql(
        f"""SELECT fips_code, variable, period_year, period_month,
                   {sql_r8("CASE WHEN variable = 'prcp' THEN sum(present) / 25.4 ELSE avg(present) * 9 / 5 + 32 END", "value")}
            FROM obs GROUP BY fips_code, variable, period_year, period_month""",
        "obs",
    ),
)
def unit_convert(spark, sf):
    long = sample.monthly_long(spark, sf, COUNTY)
    value = cleaning.month_value(F.col("variable"), F.col("day_total"), F.col("day_count"))
    return rounded(
        long.select(F.col("region_code").alias("fips_code"), "variable", *MONTH, value.alias("value")), "value"
    )


@register(
    "key_pad",
    f"""SELECT DISTINCT o_custkey AS id, {sql_pad("CAST(o_custkey AS VARCHAR)", 2)} AS state_key,
               {sql_pad("CAST(o_custkey AS VARCHAR)", 3)} AS level_key,
               {sql_pad("CAST(o_custkey AS VARCHAR)", 5)} AS county_key FROM orders""",
)
def key_pad(spark, sf):
    ids = sample.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    widths = {"state_key": 2, "level_key": 3, "county_key": 5}
    return ids.withColumns({name: values.pad_key(F.col("id"), width) for name, width in widths.items()})


@register(
    "drop_unmapped",
    sql(
        """SELECT state_fips, state_abbr, event_type, event_date, count(*) AS events
           FROM (SELECT lpad(CAST(user_id % 60 + 1 AS VARCHAR), 2, '0') AS region_code, event_type,
                        CAST(ts AS DATE) AS event_date FROM events)
           JOIN xwalk USING (region_code) GROUP BY ALL""",
        "xwalk",
    ),
)
def drop_unmapped(spark, sf):
    keys = ["region_code", "event_type", "event_date"]
    counts = sample.coded_events(spark, sf).groupBy(*keys).agg(F.count("*").alias("events"))
    return cleaning.map_codes(counts, crosswalk(spark))


# ---- staging, baseline, anomaly --------------------------------------------


@register("stage_climate", sql(f"SELECT {SQL_REGION_MONTH}, period_date, {SQL_MEASURES} FROM staged", "staged"))
def stage_climate(spark, sf):
    return rounded(models.staged(spark, sf), *MEASURE_COLUMNS)


@register(
    "baseline_avg",
    sql(f"SELECT state_fips, period_month, {sql_r8('baseline_tavg_f', 'baseline_tavg_f')} FROM normal", "normal"),
)
def baseline_avg(spark, sf):
    return rounded(marts.baseline(models.staged(spark, sf), BASE_START, BASE_END), "baseline_tavg_f")


@register(
    "baseline_from_parts",
    sql(f"SELECT state_fips, period_month, {sql_r8('baseline_tavg_f', 'baseline_tavg_f')} FROM normal", "normal"),
)
def baseline_from_parts(spark, sf):
    """From sums kept by year: all years first, then the last two again, as a load that touched them does."""
    staged = models.staged(spark, sf)
    parts = parts_table(spark, f"parts_{uuid.uuid4().hex}", fresh_path(spark, "baseline_parts"))
    parts.replace_years(baseline_parts(staged))
    parts.replace_years(baseline_parts(staged.where(F.col("period_year") >= END - 1)))
    return rounded(baseline_of_parts(parts.read(), BASE_START, BASE_END), "baseline_tavg_f")


@register("marts_refreshed", sql(f"SELECT {SQL_ANNUAL} FROM annual", "annual"))
def marts_refreshed(spark, sf):
    """The annual mart after two refreshes: up to 1999, then the two years a later load touches, which the baseline doesn't need."""
    raw = sample.state_panel(spark, sf)
    tag = uuid.uuid4().hex
    parts = parts_table(spark, f"parts_{tag}", fresh_path(spark, "baseline_parts"))
    layout = marts.mart_monthly(models.anomalies(spark, sf))
    monthly = YearTable(spark, f"monthly_{tag}", fresh_path(spark, "monthly"), ("state_fips", "period_month")).create(layout.schema)
    annual = YearTable(spark, f"annual_{tag}", fresh_path(spark, "annual"), ("state_fips",)).create(marts.mart_annual(layout).schema)
    for years in (list(range(START, END - 1)), [END - 1, END]):
        refresh_marts(raw, years, parts, monthly, annual, BASE_START, BASE_END)
    return rounded(annual.read().select(*ANNUAL_COLUMNS), *ANNUAL_VALUES)


_ANOMALY = f"""SELECT {SQL_REGION_MONTH}, period_date, {SQL_MEASURES},
    {sql_r8("baseline_tavg_f", "baseline_tavg_f")}, {sql_r8("anomaly_f", "anomaly_f")}, is_baseline_missing"""
_ANOMALY_VALUES = [*MEASURE_COLUMNS, "baseline_tavg_f", "anomaly_f"]


@register("anomaly_by_region", sql(f"{_ANOMALY} FROM anom", "anom"))
def anomaly_by_region(spark, sf):
    return rounded(models.anomalies(spark, sf), *_ANOMALY_VALUES)


@register("baseline_join", sql(f"{_ANOMALY} FROM anom", "anom"))
def baseline_join(spark, sf):
    """The join form reads its panel twice, so it runs on a stored one."""
    panel = at_rest(models.staged(spark, sf), "panel")
    joined = marts.anomaly_by_region_join(panel, BASE_START, BASE_END)
    return rounded(joined, *_ANOMALY_VALUES)


@register(
    "anomaly",
    sql(f"SELECT {SQL_REGION_MONTH}, {sql_r8('anomaly_f', 'anomaly_f')} FROM anom", "anom"),
)
def anomaly(spark, sf):
    return rounded(models.anomalies(spark, sf).select("state_fips", "state_abbr", *MONTH, "anomaly_f"), "anomaly_f")


@register(
    "baseline_missing_flag",
    sql(f"SELECT {SQL_REGION_MONTH}, is_baseline_missing FROM gap_anom", "gap_anom"),
)
def baseline_missing_flag(spark, sf):
    rows = models.anomalies(spark, sf, 2001, 2001)
    return rows.select("state_fips", "state_abbr", *MONTH, "is_baseline_missing")


@register(
    "baseline_window_param",
    sql(
        f"""SELECT {SQL_REGION_MONTH}, {sql_r8('baseline_tavg_f', 'baseline_tavg_f')},
                   {sql_r8('anomaly_f', 'anomaly_f')} FROM gap_anom""",
        "gap_anom",
    ),
)
def baseline_window_param(spark, sf):
    rows = models.anomalies(spark, sf, 2001, 2001)
    columns = ["baseline_tavg_f", "anomaly_f"]
    return rounded(rows.select("state_fips", "state_abbr", *MONTH, *columns), *columns)


@register(
    "monthly_gap_flag",
    sql(
        f"""SELECT {SQL_REGION_MONTH}, tavg_f IS NULL AS is_unmeasured,
                   tavg_f IS NULL OR is_baseline_missing AS has_data_gap FROM gap_anom""",
        "gap_anom",
    ),
)
def monthly_gap_flag(spark, sf):
    mart = marts.mart_monthly(models.anomalies(spark, sf, 2001, 2001))
    unmeasured = F.col("tavg_f").isNull().alias("is_unmeasured")
    return mart.select("state_fips", "state_abbr", *MONTH, unmeasured, "has_data_gap")


# ---- marts -----------------------------------------------------------------


@register(
    "mart_monthly",
    sql(
        f"""SELECT {SQL_REGION_MONTH}, period_date, {SQL_MEASURES}, {sql_r8('anomaly_f', 'anomaly_f')},
                   is_baseline_missing, has_data_gap FROM monthly""",
        "monthly",
    ),
)
def mart_monthly(spark, sf):
    return rounded(models.monthly(spark, sf), *MEASURE_COLUMNS, "anomaly_f")


@register("monthly_projection", sql(f"SELECT {SQL_MONTHLY} FROM monthly", "monthly"))
def monthly_projection(spark, sf):
    return rounded(models.monthly(spark, sf).select(*MONTHLY_COLUMNS), *ANNUAL_VALUES)


@register("mart_annual", sql(f"SELECT {SQL_ANNUAL} FROM annual", "annual"))
def mart_annual(spark, sf):
    return rounded(models.annual(spark, sf), *ANNUAL_VALUES)


@register(
    "annual_rollup",
    sql(
        f"""SELECT fips_code, period_year, {sql_r8('avg(tavg_f)', 'tavg_f')}, {sql_r8('avg(tmax_f)', 'tmax_f')},
                   {sql_r8('avg(tmin_f)', 'tmin_f')}, {sql_r8('sum(prcp_in)', 'prcp_in')},
                   {sql_r8('avg(tavg_f - baseline_tavg_f)', 'anomaly_f')},
                   count(*) AS months_reported, count(*) < 12 AS is_partial_year,
                   bool_or(baseline_tavg_f IS NULL) AS has_data_gap
            FROM county LEFT JOIN (
              SELECT fips_code, period_month, avg(tavg_f) AS baseline_tavg_f FROM county
              WHERE period_year BETWEEN {BASE_START} AND {BASE_END} GROUP BY ALL) AS n
            USING (fips_code, period_month)
            GROUP BY fips_code, period_year""",
        "county",
    ),
)
def annual_rollup(spark, sf):
    """County grain: as many regions as suppliers."""
    staged = marts.stage_climate(sample.county_panel(spark, sf), COUNTY)
    rows = marts.anomaly_by_region(staged, BASE_START, BASE_END, COUNTY)
    return rounded(marts.mart_annual(rows, COUNTY), *ANNUAL_VALUES)


@register("annual_projection", sql(f"SELECT {SQL_ANNUAL} FROM annual", "annual"))
def annual_projection(spark, sf):
    return rounded(models.annual(spark, sf).select(*ANNUAL_COLUMNS), *ANNUAL_VALUES)


@register(
    "partial_year_flag",
    sql(
        """SELECT fips_code, period_year, count(*) AS months_reported, count(*) < 12 AS is_partial_year
           FROM (SELECT DISTINCT fips_code, period_year, period_month FROM obs) GROUP BY ALL""",
        "obs",
    ),
)
def partial_year_flag(spark, sf):
    staged = marts.stage_climate(sample.county_panel(spark, sf), COUNTY)
    rows = marts.anomaly_by_region(staged, BASE_START, BASE_END, COUNTY)
    columns = ["fips_code", "period_year", "months_reported", "is_partial_year"]
    return marts.mart_annual(rows, COUNTY).select(*columns)


# ---- joins and reshapes ----------------------------------------------------

_LONG = """SELECT region_code, period_year, period_month, variable, sum(present) AS value
           FROM obs GROUP BY ALL"""
_WIDE = ", ".join(
    f"max(CASE WHEN variable = '{v}' THEN value END) AS {c}"
    for v, c in {"tmax": "tmax_f", "tmin": "tmin_f", "tavg": "tavg_f", "prcp": "prcp_in"}.items()
)
_PIVOT = sql(
    f"SELECT region_code, period_year, period_month, {_WIDE} FROM ({_LONG}) GROUP BY ALL", "obs"
)


def _long(spark, sf, grain):
    return sample.monthly_long(spark, sf, grain).withColumn("value", F.col("day_total"))


@register("pivot_variables", _PIVOT)
def pivot_variables(spark, sf):
    return cleaning.pivot_variables(_long(spark, sf, STATE), ["region_code", *MONTH])


@register("variable_merge", _PIVOT)
def variable_merge(spark, sf):
    return cleaning.merge_variables(_long(spark, sf, STATE), ["region_code", *MONTH])


@register(
    "missing_variable_fill",
    sql(
        f"""SELECT fips_code, period_year, period_month, {_WIDE}
            FROM (SELECT fips_code, period_year, period_month, variable, sum(present) AS value
                  FROM obs GROUP BY ALL)
            GROUP BY ALL""",
        "obs",
    ),
)
def missing_variable_fill(spark, sf):
    """County months mostly lack a variable; it becomes a null column entry."""
    wide = cleaning.pivot_variables(_long(spark, sf, COUNTY), ["region_code", *MONTH])
    return wide.withColumnRenamed("region_code", "fips_code")


@register("crosswalk_join", sql(f"SELECT {SQL_REGION_MONTH}, {SQL_MEASURES} FROM panel", "panel"))
def crosswalk_join(spark, sf):
    panel = cleaning.map_codes(sample.monthly_codes(spark, sf, STATE), crosswalk(spark))
    return rounded(panel, *MEASURE_COLUMNS)


@register(
    "county_enrich",
    sql(
        f"""SELECT fips_code, county_name, state_abbr, land_sq_mi, period_year, period_month, {SQL_MEASURES}
            FROM county LEFT JOIN (
              SELECT {sql_pad("CAST(s_suppkey AS VARCHAR)", 5)} AS fips_code, s_name AS county_name,
                     round(abs(s_acctbal), 2) AS land_sq_mi,
                     state_abbr
              FROM supplier JOIN xwalk ON region_code = lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0')) AS s
            USING (fips_code)""",
        "county",
        "xwalk",
    ),
)
def county_enrich(spark, sf):
    """Every county-month with all measures; a county the dimension lacks keeps its rows, without names."""
    dimension = county_dimension(sample.counties(spark, sf))
    dimension = dimension.withColumn("land_sq_mi", F.col("land_sq_mi").cast("double"))
    return rounded(enrich_counties(sample.county_panel(spark, sf), dimension), *MEASURE_COLUMNS)


@register(
    "county_dimension",
    sql(
        f"""SELECT {sql_pad("CAST(s_suppkey AS VARCHAR)", 5)} AS fips_code, s_name AS county_name, state_abbr,
                   state_fips, round(abs(s_acctbal), 2) AS land_sq_mi
            FROM supplier JOIN xwalk ON region_code = lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0')""",
        "xwalk",
    ),
)
def counties(spark, sf):
    dimension = county_dimension(sample.counties(spark, sf))
    return dimension.withColumn("land_sq_mi", F.col("land_sq_mi").cast("double"))


# ---- aggregates over days --------------------------------------------------

_FOLDED = """SELECT region_code, variable, period_year, period_month, status,
                    coalesce(sum(reading) FILTER (reading > -900), 0.0) AS day_total,
                    CAST(count(*) FILTER (reading > -900) AS INTEGER) AS day_count
             FROM {0} GROUP BY ALL"""


def _grid(spark, sf, grain):
    rows = sample.grid_rows(spark, sf, grain)
    name = F.split(F.regexp_replace("file", r"\.csv$", ""), "-")
    return rows.select(
        "region_code",
        F.col("file_variable").alias("variable"),
        F.col("file_year").cast("int").alias("period_year"),
        F.col("file_month").cast("int").alias("period_month"),
        name[3].alias("status"),
        *sample.DAY_COLUMNS,
    )


@register("fold_days", sql(_FOLDED.format("county_days"), "county_days"))
def fold_days(spark, sf):
    return cleaning.fold_days(_grid(spark, sf, COUNTY))


_CELL = "region_code, variable, period_year, period_month, status"


@register(
    "month_mean",
    sql(
        f"""SELECT {_CELL}, {sql_r8("avg(reading) FILTER (reading > -900)", "month_mean")}
            FROM state_days GROUP BY {_CELL}""",
        "state_days",
    ),
)
def month_mean(spark, sf):
    folded = cleaning.fold_days(_grid(spark, sf, STATE))
    mean = cleaning.month_mean(F.col("day_total"), F.col("day_count")).alias("month_mean")
    return rounded(folded.select(*_CELL.split(", "), mean), "month_mean")


@register(
    "month_sum_min1",
    sql(
        f"SELECT {_CELL}, sum(reading) FILTER (reading > -900) AS month_sum FROM state_days GROUP BY {_CELL}",
        "state_days",
    ),
)
def month_sum_min1(spark, sf):
    folded = cleaning.fold_days(_grid(spark, sf, STATE))
    total = cleaning.month_sum(F.col("day_total"), F.col("day_count")).alias("month_sum")
    return folded.select(*_CELL.split(", "), total)


# ---- series ----------------------------------------------------------------

_AROUND = "OVER (PARTITION BY {0} ORDER BY period_year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_WHOLE = "OVER (PARTITION BY state_fips ORDER BY period_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@register(
    "moving_average",
    sql(
        f"""SELECT state_fips, period_year, {sql_r8("tavg_smooth_f", "tavg_smooth_f")}
            FROM (SELECT *, avg(tavg_f) {_AROUND.format("state_fips")} AS tavg_smooth_f FROM annual)""",
        "annual",
    ),
)
def moving_average(spark, sf):
    smooth = series.moving_average("tavg_f", ["state_fips"]).alias("tavg_smooth_f")
    return rounded(models.annual(spark, sf).select("state_fips", "period_year", smooth), "tavg_smooth_f")


@register(
    "seasonal_moving_average",
    sql(
        f"""SELECT state_fips, period_year, period_month, {sql_r8("tavg_smooth_f", "tavg_smooth_f")}
            FROM (SELECT *, avg(tavg_f) {_AROUND.format("state_fips, period_month")} AS tavg_smooth_f
                  FROM monthly)""",
        "monthly",
    ),
)
def seasonal_moving_average(spark, sf):
    smooth = series.moving_average("tavg_f", ["state_fips", "period_month"]).alias("tavg_smooth_f")
    # Placed by region already, so the window needs no further exchange.
    return rounded(models.monthly(spark, sf).select("state_fips", *MONTH, smooth), "tavg_smooth_f")


@register(
    "flagship_trend",
    sql(
        f"""SELECT {SQL_ANNUAL}, {sql_r8("tavg_smooth_f", "tavg_smooth_f")},
                   {sql_r8("anomaly_smooth_f", "anomaly_smooth_f")},
                   {sql_r8("tavg_pct_from_start", "tavg_pct_from_start")}
            FROM (SELECT *, avg(tavg_f) {_AROUND.format("state_fips")} AS tavg_smooth_f,
                         avg(anomaly_f) {_AROUND.format("state_fips")} AS anomaly_smooth_f,
                         (tavg_f / nullif(first_value(tavg_f) {_WHOLE}, 0) - 1) * 100 AS tavg_pct_from_start
                  FROM annual)""",
        "annual",
    ),
)
def flagship_trend(spark, sf):
    derived = ["tavg_smooth_f", "anomaly_smooth_f", "tavg_pct_from_start"]
    return rounded(queries.flagship_trend(models.annual(spark, sf)), *ANNUAL_VALUES, *derived)
