"""Population sources and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators.quality import panel_stats
from terrapanel.operators.series import percent_from_start
from terrapanel.plans import marts, overlays
from terrapanel.plans import population as plan
from terrapanel.registry import models
from terrapanel.registry.base import register, rounded, sql, sql_r8
from terrapanel.sources import population as sources
from terrapanel.sources import sample_tables as sample
from terrapanel.sources.regions import state_lookup

_JSON = """SELECT 'Region ' || region AS "NAME", CAST(orders AS VARCHAR) AS "POP",
                  CAST(period_year - 1993 AS VARCHAR) AS "DATE_CODE", CAST(region AS VARCHAR) AS state
           FROM orders_by_region WHERE period_year <= 1998"""


@register("json_matrix_scan", sql(_JSON, "orders_by_region"))
def json_matrix_scan(spark, sf):
    return sources.read_json_matrix(spark, sample.landed_json(spark, sf), ["NAME", "POP", "DATE_CODE", "state"])


_YEARS = (1998, 1999, 2000, 2001)
_SUMS = ", ".join(
    f"CAST(coalesce(sum(orders + open_orders) FILTER (period_year = {y}), 0) AS VARCHAR) AS POPESTIMATE{y}"
    for y in _YEARS
)


@register(
    "wide_csv_scan",
    sql(
        f"""SELECT '40' AS SUMLEV, CAST(region AS VARCHAR) AS STATE, {_SUMS} FROM orders_by_region
            WHERE period_year >= 1998 GROUP BY region
            UNION ALL SELECT '10', '0', {_SUMS} FROM orders_by_region WHERE period_year >= 1998""",
        "orders_by_region",
    ),
)
def wide_csv_scan(spark, sf):
    return sources.read_wide_csv(spark, f"{sample.landed_wide_csv(spark, sf)}/{sample.VINTAGES[0]}")


@register("vintage_preference", sql("SELECT * FROM new_pop", "new_pop"))
def vintage_preference(spark, sf):
    """Both vintages are on storage; the newer one is read."""
    return sources.read_newest(spark, sample.landed_wide_csv(spark, sf), sample.VINTAGES)


@register(
    "date_code_decode",
    sql("SELECT state_fips, period_year, population, source FROM old_pop", "old_pop"),
)
def date_code_decode(spark, sf):
    return models.old_population(spark, sf)


@register(
    "summary_level_filter",
    sql(
        f"""SELECT '40' AS SUMLEV, CAST(region AS VARCHAR) AS STATE, {_SUMS} FROM orders_by_region
            WHERE period_year >= 1998 GROUP BY region""",
        "orders_by_region",
    ),
)
def summary_level_filter(spark, sf):
    return sources.state_level_only(wide_csv_scan(spark, sf))


@register("melt_years", sql("SELECT state_fips, period_year, population, source FROM new_pop", "new_pop"))
def melt_years(spark, sf):
    return models.new_population(spark, sf)


@register(
    "scope_filter",
    sql("SELECT old_pop.* FROM old_pop SEMI JOIN xwalk USING (state_fips)", "old_pop", "xwalk"),
)
def scope_filter(spark, sf):
    return plan.in_scope(models.old_population(spark, sf), state_lookup(spark))


@register(
    "vintage_union",
    sql("SELECT 0 AS source_rank, * FROM old_pop UNION ALL SELECT 1, * FROM new_pop", "old_pop", "new_pop"),
)
def vintage_union(spark, sf):
    return plan.stack_sources(models.old_population(spark, sf), models.new_population(spark, sf))


@register(
    "dedupe_keep_last",
    sql(
        """SELECT state_fips, period_year, population, source FROM (
             SELECT *, row_number() OVER (PARTITION BY state_fips, period_year ORDER BY source_rank DESC) AS rn
             FROM (SELECT 0 AS source_rank, * FROM old_pop UNION ALL SELECT 1, * FROM new_pop))
           WHERE rn = 1""",
        "old_pop",
        "new_pop",
    ),
)
def dedupe_keep_last(spark, sf):
    return plan.keep_last(vintage_union(spark, sf), ["state_fips", "period_year"])


@register(
    "source_clashes",
    sql(
        """SELECT region, period_year, 1 AS source_rank, least(orders, orders + open_orders) AS fewer,
                  greatest(orders, orders + open_orders) AS more
           FROM orders_by_region WHERE period_year >= 1998 AND open_orders > 0""",
        "orders_by_region",
    ),
)
def source_clashes(spark, sf):
    """One source that counts each region's year twice, with and without open orders: where these differ. The older years' source is
    clean, and outranked where both have a year."""
    counts = sample.order_counts(spark, sf)
    early = counts.select("region", "period_year", F.col("orders").alias("population"))
    both = counts.select("region", "period_year", (F.col("orders") + F.col("open_orders")).alias("population"))
    late = early.unionByName(both).where(F.col("period_year") >= 1998)
    found = plan.source_clashes(plan.stack_sources(early, late), ["region", "period_year"])
    number = lambda c: F.get_json_object(c, "$.population").cast("long")
    return found.select("region", "period_year", "source_rank", number("one").alias("fewer"), number("another").alias("more"))


@register(
    "abbr_lookup",
    sql("SELECT new_pop.*, state_abbr FROM new_pop JOIN xwalk USING (state_fips)", "new_pop", "xwalk"),
)
def abbr_lookup(spark, sf):
    return plan.add_abbreviation(models.new_population(spark, sf), state_lookup(spark))


@register("population_long", sql("SELECT * FROM pop", "pop"))
def population_long(spark, sf):
    return models.population(spark, sf)


@register("stage_population", sql("SELECT * FROM pop", "pop"))
def stage_population(spark, sf):
    return marts.stage_population(models.population(spark, sf))


@register(
    "panel_stats",
    sql(
        """SELECT count(*) AS row_count, count(DISTINCT state_fips) AS regions, min(period_year) AS min_year,
                  max(period_year) AS max_year FROM pop""",
        "pop",
    ),
)
def population_stats(spark, sf):
    return panel_stats(models.population(spark, sf), "state_fips")


# ---- overlays --------------------------------------------------------------


@register(
    "dataset_tag",
    sql(
        """SELECT 'census_population' AS dataset, state_fips, state_abbr, period_year,
                  CAST(population AS DOUBLE) AS value FROM pop""",
        "pop",
    ),
)
def dataset_tag(spark, sf):
    return overlays.population_overlay(models.population(spark, sf))


_OVERLAY = f"SELECT dataset, state_fips, state_abbr, period_year, {sql_r8('value', 'value')} FROM overlay"


@register("mart_overlay", sql(_OVERLAY + " WHERE dataset = 'census_population'", "overlay"))
def mart_overlay(spark, sf):
    staged = marts.stage_population(models.population(spark, sf))
    return rounded(overlays.mart_overlay(overlays.population_overlay(staged)), "value")


@register("overlay_union", sql(_OVERLAY, "overlay"))
def overlay_union(spark, sf):
    return rounded(models.overlay(spark, sf), "value")


@register(
    "climate_overlay_align",
    sql(
        f"""SELECT a.state_abbr, a.period_year, {sql_r8('a.tavg_f', 'tavg_f')},
                   CAST(p.population AS DOUBLE) AS overlay_value
            FROM annual a LEFT JOIN pop p ON a.state_abbr = p.state_abbr AND a.period_year = p.period_year""",
        "annual",
        "pop",
    ),
)
def climate_overlay_align(spark, sf):
    climate = models.annual(spark, sf).select("state_abbr", "period_year", "tavg_f")
    people = overlays.population_overlay(models.population(spark, sf))
    return rounded(overlays.align_overlay(climate, people, "census_population"), "tavg_f")


@register(
    "per_capita",
    sql(
        f"""SELECT dataset, state_fips, state_abbr, period_year, {sql_r8('value', 'value')},
                   {sql_r8('value / nullif(population, 0) * 1000', 'per_capita')}
            FROM (SELECT * FROM overlay WHERE dataset = 'climate_tavg')
            LEFT JOIN (SELECT state_fips, period_year, population FROM pop) USING (state_fips, period_year)""",
        "overlay",
        "pop",
    ),
)
def per_capita(spark, sf):
    climate = overlays.overlay_branch(models.annual(spark, sf), "climate_tavg", F.col("tavg_f"))
    people = models.population(spark, sf)
    return rounded(overlays.per_capita(climate, people, 1000).drop("population"), "value", "per_capita")


@register(
    "rebase_pct",
    sql(
        f"""SELECT state_abbr, period_year, {sql_r8('pct', 'pct_from_start')} FROM (
              SELECT *, (population / nullif(first_value(population) OVER (
                PARTITION BY state_abbr ORDER BY period_year
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) - 1) * 100 AS pct
              FROM pop WHERE period_year >= 1997)""",
        "pop",
    ),
)
def rebase_pct(spark, sf):
    """Based on 1997, the first year asked for, not on the first one on record."""
    rows = models.population(spark, sf).where(F.col("period_year") >= 1997)
    change = percent_from_start("population", ["state_abbr"]).alias("pct_from_start")
    return rounded(rows.select("state_abbr", "period_year", change), "pct_from_start")


_PEARSON = f"""SELECT state_abbr, {sql_r8('r', 'pearson_r')}, years FROM (
    SELECT state_abbr, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS r, count(*) AS years
    FROM (SELECT p.state_abbr, CAST(population AS DOUBLE) AS a, tavg_f AS b FROM pop p
          JOIN annual c ON c.state_abbr = p.state_abbr AND c.period_year = p.period_year
          WHERE tavg_f IS NOT NULL)
    GROUP BY state_abbr)"""


@register("pearson", sql(_PEARSON, "pop", "annual"))
def pearson(spark, sf):
    rows = overlays.correlate(models.overlay(spark, sf), "census_population", "climate_tavg")
    return rounded(rows, "pearson_r")
