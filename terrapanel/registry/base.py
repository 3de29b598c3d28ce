"""Registration and the SQL fragments the twins are made of.

The fragments restate the sample inputs and the models in plain SQL, so that the
twins share no code with the DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.refdata import state_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The sample data spans 1995-2001; 2001 stops in November.
BASE_START, BASE_END = 1996, 1998
START, END = 1995, 2001


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


def r8(name: str) -> Column:
    """Round once at the end; both engines sum doubles in their own order."""
    return F.round(F.col(name), 8).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r8(c) if c in names else F.col(c) for c in df.columns])


def sql_r8(expression: str, name: str) -> str:
    return f"CASE WHEN abs({expression}) < 5e-9 THEN 0.0 ELSE round({expression}, 8) END AS {name}"


MEASURE_COLUMNS = ["tmax_f", "tmin_f", "tavg_f", "prcp_in"]
SQL_MEASURES = ", ".join(sql_r8(m, m) for m in MEASURE_COLUMNS)
ANNUAL_VALUES = ["tavg_f", "tmax_f", "tmin_f", "prcp_in", "anomaly_f"]
SQL_ANNUAL = "state_fips, state_abbr, period_year, " + ", ".join(
    [sql_r8(v, v) for v in ANNUAL_VALUES] + ["months_reported", "is_partial_year", "has_data_gap"]
)
SQL_MONTHLY = (
    "state_fips, state_abbr, period_year, period_month, "
    + ", ".join(sql_r8(v, v) for v in ANNUAL_VALUES)
    + ", has_data_gap"
)


def sql_pad(text: str, width: int) -> str:
    return f"lpad({text}, CAST(greatest(length({text}), {width}) AS INTEGER), '0')"


def _panel(source: str, region: str, join: str = "") -> str:
    def mean(variable: str) -> str:
        return f"avg(CASE WHEN variable = '{variable}' THEN present END) * 9 / 5 + 32"

    return f"""
        SELECT {region}, period_year, period_month,
               {mean("tmax")} AS tmax_f, {mean("tmin")} AS tmin_f, {mean("tavg")} AS tavg_f,
               sum(CASE WHEN variable = 'prcp' THEN present END) / 25.4 AS prcp_in
        FROM {source} {join} GROUP BY {region}, period_year, period_month"""


_STATE_JOIN = "JOIN xwalk USING (region_code)"
_STATES = ", ".join(str(row) for row in state_rows())

# name -> (fragments it reads, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "xwalk": ((), f"SELECT * FROM (VALUES {_STATES}) AS t(region_code, state_fips, state_abbr)"),
    "obs": (
        (),
        f"""
        SELECT *, CASE WHEN reading > -900 THEN reading END AS present FROM (
          SELECT lpad(CAST(l_suppkey % 50 + 1 AS VARCHAR), 2, '0') AS region_code,
                 {sql_pad("CAST(l_suppkey AS VARCHAR)", 5)} AS fips_code,
                 CASE WHEN l_linenumber <= 2 THEN 'tmax' WHEN l_linenumber <= 4 THEN 'tmin'
                      WHEN l_linenumber <= 6 THEN 'tavg' ELSE 'prcp' END AS variable,
                 CAST(year(l_shipdate) AS INTEGER) AS period_year,
                 CAST(month(l_shipdate) AS INTEGER) AS period_month,
                 CAST(day(l_shipdate) AS INTEGER) AS period_day,
                 CASE WHEN year(l_shipdate) * 100 + month(l_shipdate) < 200107 AND l_linestatus = 'F'
                      THEN 'scaled' ELSE 'prelim' END AS status,
                 CASE WHEN l_tax = 0 THEN -999.99 ELSE l_quantity END AS reading
          FROM lineitem)""",
    ),
    "panel": (("xwalk", "obs"), _panel("obs", "state_fips, state_abbr", _STATE_JOIN)),
    "county": (("obs",), _panel("obs", "fips_code")),
    "staged": (
        ("panel",),
        "SELECT *, make_date(period_year, period_month, 1) AS period_date FROM panel",
    ),
    "normal": (
        ("staged",),
        f"""SELECT state_fips, period_month, avg(tavg_f) AS baseline_tavg_f FROM staged
            WHERE period_year BETWEEN {BASE_START} AND {BASE_END} GROUP BY ALL""",
    ),
    "anom": (
        ("staged", "normal"),
        """SELECT s.*, baseline_tavg_f, tavg_f - baseline_tavg_f AS anomaly_f,
                  baseline_tavg_f IS NULL AS is_baseline_missing
           FROM staged s LEFT JOIN normal USING (state_fips, period_month)""",
    ),
    "monthly": (
        ("anom",),
        """SELECT state_fips, state_abbr, period_year, period_month, period_date, tmax_f, tmin_f, tavg_f,
                  prcp_in, anomaly_f, is_baseline_missing,
                  tavg_f IS NULL OR is_baseline_missing AS has_data_gap FROM anom""",
    ),
    "annual": (
        ("anom",),
        """SELECT state_fips, state_abbr, period_year, avg(tavg_f) AS tavg_f, avg(tmax_f) AS tmax_f,
                  avg(tmin_f) AS tmin_f, sum(prcp_in) AS prcp_in, avg(anomaly_f) AS anomaly_f,
                  count(period_month) AS months_reported, count(period_month) < 12 AS is_partial_year,
                  bool_or(is_baseline_missing) AS has_data_gap
           FROM anom GROUP BY ALL""",
    ),
    # December is missing from the one-year window, so flags differ here.
    "gap_normal": (
        ("staged",),
        """SELECT state_fips, period_month, avg(tavg_f) AS baseline_tavg_f FROM staged
           WHERE period_year BETWEEN 2001 AND 2001 GROUP BY ALL""",
    ),
    "gap_anom": (
        ("staged", "gap_normal"),
        """SELECT s.*, baseline_tavg_f, tavg_f - baseline_tavg_f AS anomaly_f,
                  baseline_tavg_f IS NULL AS is_baseline_missing
           FROM staged s LEFT JOIN gap_normal USING (state_fips, period_month)""",
    ),
    # Daily cells: the largest reading of a day, so a marker stands only where nothing else does.
    "days": (
        ("obs",),
        """SELECT region_code, fips_code, variable, period_year, period_month, period_day, status, reading
           FROM obs""",
    ),
    "state_days": (
        ("days",),
        """SELECT region_code, variable, period_year, period_month, status, period_day, max(reading) AS reading
           FROM days GROUP BY ALL""",
    ),
    "county_days": (
        ("days",),
        """SELECT fips_code AS region_code, variable, period_year, period_month, status, period_day,
                  max(reading) AS reading
           FROM days GROUP BY ALL""",
    ),
    # The preferred status is decided per variable and month, as files are.
    "chosen": (
        ("obs",),
        """SELECT variable, period_year, period_month, max(status) AS status FROM obs GROUP BY ALL""",
    ),
    "state_grid": (
        ("state_days", "chosen"),
        "SELECT * FROM state_days SEMI JOIN chosen USING (variable, period_year, period_month, status)",
    ),
    "county_grid": (
        ("county_days", "chosen"),
        "SELECT * FROM county_days SEMI JOIN chosen USING (variable, period_year, period_month, status)",
    ),
    "orders_by_region": (
        (),
        """SELECT o_custkey % 56 + 1 AS region, CAST(year(o_orderdate) AS INTEGER) AS period_year,
                  count(*) AS orders, count(*) FILTER (o_orderstatus = 'P') AS open_orders
           FROM orders GROUP BY ALL""",
    ),
    "old_pop": (
        ("orders_by_region",),
        """SELECT lpad(CAST(region AS VARCHAR), 2, '0') AS state_fips, period_year, orders AS population,
                  'api_2019_vintage' AS source
           FROM orders_by_region WHERE period_year BETWEEN 1996 AND 1998""",
    ),
    "region_years": (
        ("orders_by_region",),
        """SELECT r.region, CAST(y.period_year AS INTEGER) AS period_year
           FROM (SELECT DISTINCT region FROM orders_by_region WHERE period_year >= 1998) r,
                (VALUES (1998), (1999), (2000), (2001)) AS y(period_year)""",
    ),
    "new_pop": (
        ("region_years", "orders_by_region"),
        """SELECT lpad(CAST(region AS VARCHAR), 2, '0') AS state_fips, period_year,
                  coalesce(orders + open_orders, 0) AS population, '1998-2001' AS source
           FROM region_years LEFT JOIN orders_by_region USING (region, period_year)""",
    ),
    "pop": (
        ("old_pop", "new_pop", "xwalk"),
        """SELECT state_fips, state_abbr, period_year, population, source FROM (
             SELECT * FROM new_pop
             UNION ALL SELECT * FROM old_pop ANTI JOIN new_pop USING (state_fips, period_year))
           JOIN xwalk USING (state_fips)""",
    ),
    "overlay": (
        ("pop", "annual"),
        """SELECT 'census_population' AS dataset, state_fips, state_abbr, period_year,
                  CAST(population AS DOUBLE) AS value FROM pop
           UNION ALL SELECT 'climate_tavg', state_fips, state_abbr, period_year, tavg_f FROM annual""",
    ),
}


def sql(select: str, *reads: str) -> str:
    """Prefix a statement with the fragments it reads and all they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in reads:
        visit(name)
    if not ordered:
        return select
    body = ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in ordered)
    return f"WITH {body}\n{select}"
