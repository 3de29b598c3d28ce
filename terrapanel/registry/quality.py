"""Quality reports and unknown codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import cleaning, upsert
from terrapanel.operators import quality as q
from terrapanel.plans import marts
from terrapanel.plans.checks import REQUIRED, UNIQUE, model_checks
from terrapanel.registry import models
from terrapanel.registry.base import BASE_END, BASE_START, END, START, register, sql
from terrapanel.schemas import KEYS, STATE
from terrapanel.session import fresh_path, staged
from terrapanel.sources import sample_tables as sample
from terrapanel.sources.regions import crosswalk, state_lookup

_EVENT_CODES = "(SELECT lpad(CAST(user_id % 60 + 1 AS VARCHAR), 2, '0') AS region_code FROM events)"


@register("distinct_codes", f"SELECT DISTINCT region_code FROM {_EVENT_CODES}")
def distinct_codes(spark, sf):
    return cleaning.distinct_codes(sample.coded_events(spark, sf))


@register(
    "unmatched_codes",
    sql(f"SELECT DISTINCT region_code FROM {_EVENT_CODES} ANTI JOIN xwalk USING (region_code)", "xwalk"),
)
def unmatched_codes(spark, sf):
    return cleaning.unmapped(distinct_codes(spark, sf), crosswalk(spark))


@register(
    "code_difference",
    sql(
        """SELECT lpad(CAST(l_suppkey % 50 + 1 AS VARCHAR), 2, '0') AS region_code FROM lineitem
           EXCEPT SELECT region_code FROM xwalk""",
        "xwalk",
    ),
)
def code_difference(spark, sf):
    numbers = sample.readings(spark, sf).select("region_number").distinct()
    return sample.named(numbers, STATE).subtract(crosswalk(spark).select("region_code"))


@register(
    "unmapped_report",
    sql(
        f"""SELECT region_code, count(*) AS dropped_rows FROM {_EVENT_CODES}
            ANTI JOIN xwalk USING (region_code) GROUP BY region_code""",
        "xwalk",
    ),
)
def unmapped_report(spark, sf):
    return q.unmapped_report(cleaning.unmapped(sample.coded_events(spark, sf), crosswalk(spark)))


def _sql_nulls(table: str, name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT 'not_null' AS rule, '{name}' AS table_name, '{c}' AS subject,
                   count(*) FILTER ({c} IS NULL) AS failing_rows FROM {table}"""
        for c in columns
    )


_MONTHLY_REQUIRED = ["state_fips", "period_year", "period_month", "period_date", "tavg_f", "prcp_in"]
_POPULATION_REQUIRED = ["state_fips", "period_year", "population"]
_OVERLAY_REQUIRED = ["value"]


@register(
    "not_null",
    sql(
        _sql_nulls("gap_anom", "monthly", _MONTHLY_REQUIRED)
        + " UNION ALL "
        + _sql_nulls("pop", "population", _POPULATION_REQUIRED)
        + " UNION ALL "
        + _sql_nulls("overlay", "overlay", _OVERLAY_REQUIRED),
        "gap_anom",
        "pop",
        "overlay",
    ),
)
def not_null(spark, sf):
    """Temperature and rain are allowed to be null; here they show that nulls are counted."""
    monthly = q.not_null(models.stored_monthly(spark, sf), "monthly", _MONTHLY_REQUIRED)
    people = q.not_null(models.stored_population(spark, sf), "population", _POPULATION_REQUIRED)
    return monthly.unionByName(people).unionByName(
        q.not_null(models.stored_overlay(spark, sf), "overlay", _OVERLAY_REQUIRED)
    )


def _sql_unique(table: str, name: str, keys: list[str]) -> str:
    return f"""SELECT 'unique_key' AS rule, '{name}' AS table_name, '{"+".join(keys)}' AS subject,
                      count(*) AS failing_rows
               FROM (SELECT 1 FROM {table} GROUP BY {", ".join(keys)} HAVING count(*) > 1)"""


_COARSE = ["state_fips", "period_year"]


@register(
    "unique_key",
    sql(
        " UNION ALL ".join(
            [
                _sql_unique("monthly", "mart_monthly", KEYS["mart_monthly"]),
                _sql_unique("monthly", "coarse_monthly", _COARSE),
                _sql_unique("annual", "mart_annual", KEYS["mart_annual"]),
                _sql_unique("overlay", "mart_overlay", KEYS["mart_overlay"]),
            ]
        ),
        "monthly",
        "annual",
        "overlay",
    ),
)
def unique_key(spark, sf):
    """The second report uses too few columns on purpose, so that it finds clashes."""
    monthly = models.stored_monthly(spark, sf)
    annual, overlay = models.stored_annual(spark, sf), models.stored_overlay(spark, sf)
    return (
        q.unique_key(monthly, "mart_monthly", KEYS["mart_monthly"])
        .unionByName(q.unique_key(monthly, "coarse_monthly", _COARSE))
        .unionByName(q.unique_key(annual, "mart_annual", KEYS["mart_annual"]))
        .unionByName(q.unique_key(overlay, "mart_overlay", KEYS["mart_overlay"]))
    )


@register(
    "unique_key_kept",
    sql(
        _sql_unique("monthly", "mart_monthly", KEYS["mart_monthly"])
        + " UNION ALL "
        + _sql_unique("monthly", "coarse_monthly", _COARSE),
        "monthly",
    ),
)
def unique_key_kept(spark, sf):
    """The same reports from counts kept by year, of which the last two years' are counted again."""
    monthly = models.stored_monthly(spark, sf)
    reports = []
    for name, keys in (("mart_monthly", KEYS["mart_monthly"]), ("coarse_monthly", _COARSE)):
        counts = fresh_path(spark, f"counts_{name}")
        for years in (list(range(START, END + 1)), [END - 1, END]):
            upsert.keep_key_counts(monthly, counts, keys, "period_year", years)
        reports.append(q.unique_key_from_counts(spark.read.parquet(counts), name, keys))
    return reports[0].unionByName(reports[1])


_MODEL_TABLES = {
    "raw_climate": "panel",
    "raw_population": "pop",
    "staged_climate": "staged",
    "anomalies": "anom",
    "mart_monthly": "monthly",
    "mart_annual": "annual",
    "staged_population": "pop",
    "mart_overlay": "overlay",
}


@register(
    "model_checks",
    sql(
        " UNION ALL ".join(
            [_sql_nulls(cte, name, REQUIRED[name]) for name, cte in _MODEL_TABLES.items()]
            + [_sql_unique(_MODEL_TABLES[name], name, KEYS[name]) for name in UNIQUE]
        ),
        *dict.fromkeys(_MODEL_TABLES.values()),
    ),
)
def all_model_checks(spark, sf):
    """The thirteen not-null and three key rules over all layers; the raw panel is stored first."""
    raw = staged(sample.state_panel(spark, sf), "raw-panel")
    staged_climate = marts.stage_climate(raw)
    people = models.stored_population(spark, sf)
    return model_checks(
        {
            "raw_climate": raw,
            "raw_population": people,
            "staged_climate": staged_climate,
            "anomalies": marts.anomaly_by_region(staged_climate, BASE_START, BASE_END),
            "mart_monthly": models.stored_monthly(spark, sf),
            "mart_annual": models.stored_annual(spark, sf),
            "staged_population": marts.stage_population(people),
            "mart_overlay": models.stored_overlay(spark, sf),
        }
    )


@register(
    "completeness",
    sql(
        """SELECT count(*) AS row_count, CAST(48 * (max(period_year) - 1996 + 1) AS BIGINT) AS expected_rows,
                  count(*) = 48 * (max(period_year) - 1996 + 1) AS is_complete FROM pop""",
        "pop",
    ),
)
def completeness(spark, sf):
    return q.completeness(models.population(spark, sf), 48, 1996, "state_fips")


@register(
    "missing_cells",
    sql(
        """SELECT x.state_fips, CAST(y.y AS INTEGER) AS period_year
           FROM xwalk x, generate_series(1995, 2001) AS y(y)
           ANTI JOIN pop ON pop.state_fips = x.state_fips AND pop.period_year = y.y""",
        "xwalk",
        "pop",
    ),
)
def missing_cells(spark, sf):
    """1995 is not in the population sources, so its cells are reported."""
    return q.missing_cells(models.stored_population(spark, sf), state_lookup(spark), 1995, "state_fips")


@register(
    "domain_check",
    sql(
        """SELECT 'domain' AS rule, 'readings' AS table_name, unnest(['month_in_year', 'day_in_month', 'is_measured'])
                  AS subject,
                  unnest([count(*) FILTER (period_month NOT BETWEEN 1 AND 12),
                          count(*) FILTER (period_day NOT BETWEEN 1 AND 31),
                          count(*) FILTER (reading <= -900)]) AS failing_rows FROM obs""",
        "obs",
    ),
)
def domain_check(spark, sf):
    rules = {
        "month_in_year": F.col("period_month").between(1, 12),
        "day_in_month": F.col("period_day").between(1, 31),
        "is_measured": F.col("reading") > -900,
    }
    return q.domain_check(sample.readings(spark, sf), "readings", rules)
