"""Parametrised reads and chart feeds, run on the marts at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.plans import queries
from terrapanel.refdata import state_rows
from terrapanel.registry import models
from terrapanel.registry.base import (
    ANNUAL_VALUES,
    BASE_END,
    BASE_START,
    END,
    SQL_ANNUAL,
    SQL_MONTHLY,
    START,
    register,
    rounded,
    sql,
    sql_r8,
)
from terrapanel.registry.population import _PEARSON
from terrapanel.schemas import ANNUAL_COLUMNS, COUNTY, MONTHLY_COLUMNS, mart_columns

# XX is asked for and has no rows.
STATES = "tx, FL ,NY,XX"
_IN_STATES = "state_abbr IN ('TX', 'FL', 'NY', 'XX')"


@register("annual_map", sql(f"SELECT {SQL_ANNUAL} FROM annual WHERE period_year = 1998", "annual"))
def annual_map(spark, sf):
    return rounded(queries.annual_map(models.stored_annual(spark, sf), 1998), *ANNUAL_VALUES)


_COMPARE = """SELECT '{0}' AS side, {1} FROM annual WHERE period_year = {2}"""


@register(
    "compare_years",
    sql(
        _COMPARE.format("start", SQL_ANNUAL, START) + " UNION ALL " + _COMPARE.format("end", SQL_ANNUAL, END),
        "annual",
    ),
)
def compare_years(spark, sf):
    return rounded(queries.compare_years(models.stored_annual(spark, sf), START, END), *ANNUAL_VALUES)


@register(
    "year_nest",
    sql(
        _COMPARE.format("start", SQL_ANNUAL, 1999) + " UNION ALL " + _COMPARE.format("end", SQL_ANNUAL, 1999),
        "annual",
    ),
)
def year_nest(spark, sf):
    """The same year on both sides."""
    return rounded(queries.compare_years(models.stored_annual(spark, sf), 1999, 1999), *ANNUAL_VALUES)


@register("latest_year", sql("SELECT max(period_year) AS latest_year FROM monthly", "monthly"))
def latest_year(spark, sf):
    return queries.latest_year(models.stored_monthly(spark, sf))


@register(
    "latest_month_in_year",
    sql(
        """SELECT period_year, max(period_month) AS period_month FROM monthly
           WHERE period_year = (SELECT max(period_year) FROM monthly) GROUP BY period_year""",
        "monthly",
    ),
)
def latest_month_in_year(spark, sf):
    return queries.latest_month(models.stored_monthly(spark, sf))


_CUT = "period_month <= (SELECT max(period_month) FROM monthly WHERE period_year = 2001)"


@register(
    "year_anomaly_cutoff",
    sql(
        f"""SELECT state_abbr, period_year, {sql_r8('avg(anomaly_f)', 'anomaly_f')} FROM monthly
            WHERE period_year IN (1995, 2001) AND {_CUT} GROUP BY state_abbr, period_year""",
        "monthly",
    ),
)
def year_anomaly_cutoff(spark, sf):
    return rounded(queries.year_anomalies(models.stored_monthly(spark, sf), START), "anomaly_f")


@register(
    "period_avg_temp",
    sql(
        f"""SELECT state_abbr, {sql_r8('avg(tavg_f)', 'avg_tavg_f')} FROM monthly
            WHERE period_year BETWEEN 1996 AND 2000 GROUP BY state_abbr""",
        "monthly",
    ),
)
def period_avg_temp(spark, sf):
    return rounded(queries.average_temperature(models.stored_monthly(spark, sf), 1996, 2000), "avg_tavg_f")


_CHANGE = f"""SELECT state_abbr,
    avg(anomaly_f) FILTER (period_year = 2001 AND {_CUT})
      - avg(anomaly_f) FILTER (period_year = 1995 AND {_CUT}) AS change_f,
    avg(tavg_f) AS avg_tavg_f FROM monthly WHERE period_year BETWEEN 1995 AND 2001 GROUP BY state_abbr"""


@register(
    "period_summary",
    sql(
        f"""SELECT state_abbr, {sql_r8('change_f', 'change_f')}, {sql_r8('avg_tavg_f', 'avg_tavg_f')},
                   1995 AS start_year, 2001 AS end_year, 11 AS months_compared FROM ({_CHANGE})""",
        "monthly",
    ),
)
def period_summary(spark, sf):
    return rounded(queries.period_summary(models.stored_monthly(spark, sf), START), "change_f", "avg_tavg_f")


@register(
    "period_change_join",
    sql(
        f"""SELECT s.state_abbr, {sql_r8('e.anomaly_f - s.anomaly_f', 'change_f')}
            FROM (SELECT state_abbr, avg(anomaly_f) AS anomaly_f FROM monthly WHERE period_year = 1996
                  AND period_month <= 12 GROUP BY ALL) s
            JOIN (SELECT state_abbr, avg(anomaly_f) AS anomaly_f FROM monthly WHERE period_year = 2000
                  AND period_month <= 12 GROUP BY ALL) e ON s.state_abbr = e.state_abbr""",
        "monthly",
    ),
)
def period_change_join(spark, sf):
    summary = queries.period_summary(models.stored_monthly(spark, sf), 1996, 2000)
    return rounded(summary.select("state_abbr", "change_f"), "change_f")


@register(
    "period_map_series",
    sql(
        f"""SELECT state_abbr, {sql_r8('change_f', 'value')}, true AS is_partial_comparison FROM ({_CHANGE})""",
        "monthly",
    ),
)
def period_map_series(spark, sf):
    return rounded(queries.period_map_series(queries.period_summary(models.stored_monthly(spark, sf), START)), "value")


@register(
    "state_trend",
    sql(f"SELECT {SQL_ANNUAL} FROM annual WHERE state_abbr = 'GA' ORDER BY period_year", "annual"),
)
def state_trend(spark, sf):
    return rounded(queries.state_trend(models.stored_annual(spark, sf), "ga", START), *ANNUAL_VALUES)


@register(
    "order_by_year",
    sql(
        f"SELECT {SQL_ANNUAL} FROM annual WHERE state_abbr = 'TX' AND period_year <= 1999 ORDER BY period_year",
        "annual",
    ),
)
def order_by_year(spark, sf):
    return rounded(queries.state_trend(models.stored_annual(spark, sf), "TX", START, 1999), *ANNUAL_VALUES)


_TREND = sql(
    f"""SELECT {SQL_ANNUAL} FROM annual WHERE {_IN_STATES} AND period_year BETWEEN 1996 AND 2000
        ORDER BY state_abbr, period_year""",
    "annual",
)


@register("states_trend", _TREND)
def states_trend(spark, sf):
    return rounded(queries.states_trend(models.stored_annual(spark, sf), STATES, 1996, 2000), *ANNUAL_VALUES)


@register(
    "states_trend_all",
    sql(f"SELECT {SQL_ANNUAL} FROM annual ORDER BY state_abbr, period_year", "annual"),
)
def states_trend_all(spark, sf):
    """All 48 states asked for at once."""
    wanted = [postal for _, _, postal in state_rows()]
    return rounded(queries.states_trend(models.stored_annual(spark, sf), wanted, START), *ANNUAL_VALUES)


@register(
    "overlay_response",
    sql(
        """SELECT r.position, r.state_abbr, 'Population' AS label, 'people' AS unit, n.points
           FROM (VALUES (0, 'TX'), (1, 'FL'), (2, 'NY'), (3, 'XX')) AS r(position, state_abbr)
           LEFT JOIN (SELECT state_abbr, string_agg(period_year || '=' || population, ',' ORDER BY period_year) AS points
                      FROM pop GROUP BY state_abbr) n ON n.state_abbr = r.state_abbr""",
        "pop",
    ),
)
def overlay_response(spark, sf):
    """A series for every region asked for, an empty one for XX, with label and unit."""
    nested = queries.overlay_response(models.stored_overlay(spark, sf), "census_population", STATES, START)
    point = F.transform(
        "series", lambda p: F.concat_ws("=", p["period_year"].cast("string"), p["value"].cast("long").cast("string"))
    )
    points = F.when(F.size("series") > 0, F.array_join(point, ","))
    return nested.select("position", "state_abbr", "label", "unit", points.alias("points"))


@register("order_by_region_year", sql(f"SELECT {SQL_ANNUAL} FROM annual ORDER BY state_abbr, period_year", "annual"))
def order_by_region_year(spark, sf):
    rows = models.stored_annual(spark, sf).select(*ANNUAL_COLUMNS)
    return rounded(rows.orderBy("state_abbr", "period_year"), *ANNUAL_VALUES)


@register("region_filter", sql(f"SELECT {SQL_ANNUAL} FROM annual WHERE {_IN_STATES}", "annual"))
def region_filter(spark, sf):
    return rounded(queries.in_regions(models.stored_annual(spark, sf), queries.requested_ids(STATES)), *ANNUAL_VALUES)


@register(
    "period_predicates",
    sql(
        f"""SELECT {SQL_MONTHLY} FROM monthly
            WHERE period_year BETWEEN 1996 AND 2000 AND period_month <= 6 AND period_month IN (1, 6, 9)""",
        "monthly",
    ),
)
def period_predicates(spark, sf):
    month = F.col("period_month")
    rows = models.stored_monthly(spark, sf).where(F.col("period_year").between(1996, 2000) & (month <= 6) & month.isin(1, 6, 9))
    return rounded(rows.select(*MONTHLY_COLUMNS), *ANNUAL_VALUES)


@register(
    "month_drilldown",
    sql(
        f"SELECT {SQL_MONTHLY} FROM monthly WHERE state_abbr = 'GA' AND period_month = 7 ORDER BY period_year",
        "monthly",
    ),
)
def month_drilldown(spark, sf):
    return rounded(queries.month_drilldown(models.stored_monthly(spark, sf), "ga", 7), *ANNUAL_VALUES)


_AROUND = "OVER (PARTITION BY {0} ORDER BY period_year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@register(
    "drilldown_chart_series",
    sql(
        f"""SELECT state_abbr, period_month, period_year, {sql_r8('smooth', 'value')}
            FROM (SELECT *, avg(tavg_f) {_AROUND.format('state_abbr')} AS smooth FROM monthly
                  WHERE state_abbr = 'GA' AND period_month = 7)""",
        "monthly",
    ),
)
def drilldown_chart_series(spark, sf):
    return rounded(queries.drilldown_chart_series(models.stored_monthly(spark, sf), "GA", 7), "value")


@register(
    "series_nest",
    sql(
        f"""SELECT r.position, r.state_abbr, CAST(coalesce(n.n_years, 0) AS INTEGER) AS n_years, n.years,
                   {sql_r8('n.last_tavg', 'last_tavg_f')}
            FROM (VALUES (0, 'TX'), (1, 'FL'), (2, 'NY'), (3, 'XX')) AS r(position, state_abbr)
            LEFT JOIN (SELECT state_abbr, count(*) AS n_years,
                              string_agg(CAST(period_year AS VARCHAR), ',' ORDER BY period_year) AS years,
                              arg_max(tavg_f, period_year) AS last_tavg
                       FROM annual GROUP BY state_abbr) n ON n.state_abbr = r.state_abbr
            ORDER BY r.position""",
        "annual",
    ),
)
def series_nest(spark, sf):
    """Nested per region, then summarised so that both engines can compare it."""
    nested = queries.nested_by_request(models.stored_annual(spark, sf), STATES, ["tavg_f"])
    years = F.array_join(F.transform("series", lambda point: point["period_year"].cast("string")), ",")
    return nested.select(
        "position",
        "state_abbr",
        F.size("series").alias("n_years"),
        F.when(F.size("series") > 0, years).alias("years"),
        F.round(F.try_element_at("series", F.lit(-1))["tavg_f"], 8).alias("last_tavg_f"),
    )


@register(
    "overlay_series",
    sql(
        f"""SELECT state_abbr, period_year, CAST(population AS DOUBLE) AS value FROM pop
            WHERE {_IN_STATES} ORDER BY state_abbr, period_year""",
        "pop",
    ),
)
def overlay_series(spark, sf):
    return queries.overlay_series(models.stored_overlay(spark, sf), "census_population", STATES, START)


@register("correlation", sql(_PEARSON + " WHERE state_abbr = 'TX'", "pop", "annual"))
def correlation(spark, sf):
    rows = queries.correlation(models.stored_overlay(spark, sf), "census_population", "climate_tavg", "tx")
    return rounded(rows, "pearson_r")


@register(
    "trend_chart_series",
    sql(
        f"""SELECT 'climate' AS line, state_abbr, period_year, {sql_r8('smooth', 'value')}
            FROM (SELECT *, avg(anomaly_f) {_AROUND.format('state_abbr')} AS smooth FROM annual
                  WHERE {_IN_STATES} AND period_year BETWEEN 1996 AND 2000)
            UNION ALL
            SELECT 'overlay', state_abbr, period_year, {sql_r8('pct', 'value')}
            FROM (SELECT *, (population / nullif(first_value(population) OVER (
                    PARTITION BY state_abbr ORDER BY period_year
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) - 1) * 100 AS pct
                  FROM pop WHERE {_IN_STATES} AND period_year BETWEEN 1996 AND 2000)""",
        "annual",
        "pop",
    ),
)
def trend_chart_series(spark, sf):
    overlay = models.stored_overlay(spark, sf)
    lines = queries.trend_chart_series(models.stored_annual(spark, sf), STATES, 1996, 2000, overlay=overlay)
    return rounded(lines, "value")


# ---- county grain ----------------------------------------------------------

_COUNTY_NORMAL = f"""county LEFT JOIN (
    SELECT fips_code, period_month, avg(tavg_f) AS baseline_tavg_f FROM county
    WHERE period_year BETWEEN {BASE_START} AND {BASE_END} GROUP BY ALL) AS n USING (fips_code, period_month)"""
_COUNTY_ANNUAL = f"""SELECT fips_code, period_year, {sql_r8('avg(tavg_f)', 'tavg_f')}, {sql_r8('avg(tmax_f)', 'tmax_f')},
       {sql_r8('avg(tmin_f)', 'tmin_f')}, {sql_r8('sum(prcp_in)', 'prcp_in')},
       {sql_r8('avg(tavg_f - baseline_tavg_f)', 'anomaly_f')}, count(*) AS months_reported,
       count(*) < 12 AS is_partial_year, bool_or(baseline_tavg_f IS NULL) AS has_data_gap
    FROM {_COUNTY_NORMAL} GROUP BY fips_code, period_year"""


@register("county_mart_annual", sql(_COUNTY_ANNUAL, "county"))
def county_mart_annual(spark, sf):
    """The stored annual mart of all counties."""
    return rounded(models.county_annual(spark, sf).select(*mart_columns(ANNUAL_COLUMNS, COUNTY)), *ANNUAL_VALUES)


@register(
    "county_trend",
    sql(f"SELECT * FROM ({_COUNTY_ANNUAL}) WHERE fips_code IN ('00001', '00007') AND period_year >= 1996", "county"),
)
def county_trend(spark, sf):
    rows = queries.states_trend(models.county_annual(spark, sf), "00001,00007", 1996, grain=COUNTY)
    return rounded(rows, *ANNUAL_VALUES)


@register(
    "county_period_summary",
    sql(
        f"""SELECT * FROM (
            WITH rows AS (SELECT fips_code, period_year, period_month, tavg_f, tavg_f - baseline_tavg_f AS anomaly_f
                          FROM {_COUNTY_NORMAL}),
            last AS (SELECT max(period_year * 100 + period_month) AS ym FROM rows)
            SELECT fips_code,
                   {sql_r8("avg(anomaly_f) FILTER (period_year = ym // 100 AND period_month <= ym % 100) - "
                           "avg(anomaly_f) FILTER (period_year = 1995 AND period_month <= ym % 100)", 'change_f')},
                   {sql_r8('avg(tavg_f)', 'avg_tavg_f')}, 1995 AS start_year, CAST(any_value(ym // 100) AS INTEGER) AS end_year,
                   CAST(any_value(ym % 100) AS INTEGER) AS months_compared
            FROM rows, last GROUP BY fips_code)""",
        "county",
    ),
)
def county_period_summary(spark, sf):
    rows = queries.period_summary(models.county_monthly(spark, sf), START, grain=COUNTY)
    return rounded(rows, "change_f", "avg_tavg_f")
