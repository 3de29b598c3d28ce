"""Grid files: listing, selection, scan, fold to the monthly panel.

The files are first written from the whole lineitem table to the shared folder, in folders by scale, month, variable and status. What
there is comes from the catalog's partitions; superseded folders are pruned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import cleaning
from terrapanel.registry.base import (
    MEASURE_COLUMNS,
    SQL_MEASURES,
    register,
    rounded,
    sql,
    sql_r8,
)
from terrapanel.schemas import COUNTY, DAY_COLUMNS, GRID_SCHEMA, STATE
from terrapanel.sources import daily_grid as grid
from terrapanel.sources import landed_grid
from terrapanel.sources import sample_tables as sample
from terrapanel.sources.regions import crosswalk

MONTH = ["period_year", "period_month"]

_DAY_TEXTS = ", ".join(
    f"max(CASE WHEN period_day = {n} THEN ' ' || CAST(reading AS VARCHAR) END) AS {name}"
    for n, name in enumerate(DAY_COLUMNS, 1)
)
_SCAN = f"SELECT region_code, variable, period_year, period_month, status, {_DAY_TEXTS} FROM {{0}} GROUP BY ALL"


def mart_from_grid(days: str, region: str) -> str:
    def mean(variable: str) -> str:
        return f"avg(reading) FILTER (variable = '{variable}' AND reading > -900) * 9 / 5 + 32"

    return f"""SELECT {region}, period_year, period_month, {mean("tmax")} AS tmax_f, {mean("tmin")} AS tmin_f,
                      {mean("tavg")} AS tavg_f,
                      sum(reading) FILTER (variable = 'prcp' AND reading > -900) / 25.4 AS prcp_in
               FROM {days} GROUP BY {region}, period_year, period_month"""


def _scan(spark, sf, grain):
    rows = sample.landing(spark, sf, grain).scan(grain.scale)
    return rows.select("region_code", "variable", *MONTH, "status", *DAY_COLUMNS)


@register("flat_scan_state", sql(_SCAN.format("state_grid"), "state_grid"))
def flat_scan_state(spark, sf):
    """As daily_grid_scan_state, from a flat folder whose file names tell everything."""
    rows = grid.scan_grid(spark, sample.landed_grid(spark, sf, STATE), STATE.scale)
    return rows.select("region_code", "variable", *MONTH, "status", *DAY_COLUMNS)


@register("daily_grid_scan_state", sql(_SCAN.format("state_grid"), "state_grid"))
def daily_grid_scan_state(spark, sf):
    return _scan(spark, sf, STATE)


@register("daily_grid_scan_county", sql(_SCAN.format("county_grid"), "county_grid"))
def daily_grid_scan_county(spark, sf):
    return _scan(spark, sf, COUNTY)


@register("landed_scan_county", sql(_SCAN.format("county_grid"), "county_grid"))
def landed_scan_county(spark, sf):
    """As daily_grid_scan_county, from files landed in folders."""
    rows = landed_grid.scan(spark, sample.landed_folders(spark, sf, COUNTY), COUNTY.scale)
    return rows.select("region_code", "variable", *MONTH, "status", *DAY_COLUMNS)


@register(
    "monthly_from_landed_county",
    sql(
        f"""SELECT region_code AS fips_code, period_year, period_month, {SQL_MEASURES}
            FROM ({mart_from_grid("county_grid", "region_code")}) WHERE period_year >= 2000""",
        "county_grid",
    ),
)
def monthly_from_landed_county(spark, sf):
    """The county panel of two years; other years' folders are not opened."""
    rows = landed_grid.scan(spark, sample.landed_folders(spark, sf, COUNTY), COUNTY.scale, (2000, 2001))
    columns = ["region_code", "variable", *MONTH, *DAY_COLUMNS]
    return rounded(cleaning.monthly_from_grid(rows.select(*columns), COUNTY), *MEASURE_COLUMNS)


_FILE_COLUMNS = """variable || '-' || CAST(period_year * 100 + period_month AS VARCHAR) || '-{0}-' || status || '.csv'
    AS file_name, variable, period_year, period_month, '{0}' AS scale, status,
    CASE status WHEN 'scaled' THEN 0 ELSE 1 END AS status_rank"""


def _listing(spark, sf, grain):
    return sample.landing(spark, sf, grain).partitions().where(F.col("scale") == grain.scale)


@register("flat_file_metadata", sql(f"SELECT DISTINCT {_FILE_COLUMNS.format('ste')} FROM obs", "obs"))
def flat_file_metadata(spark, sf):
    """As file_metadata, from names in a flat folder."""
    return grid.list_files(spark, sample.landed_grid(spark, sf, STATE)).select(*grid.FILE_TAGS).distinct()


@register("file_metadata", sql(f"SELECT DISTINCT {_FILE_COLUMNS.format('ste')} FROM obs", "obs"))
def file_metadata(spark, sf):
    return _listing(spark, sf, STATE).select(*grid.FILE_TAGS).distinct()


@register(
    "status_preference",
    sql(f"SELECT DISTINCT {_FILE_COLUMNS.format('cty')} FROM obs SEMI JOIN chosen "
        "USING (variable, period_year, period_month, status)", "obs", "chosen"),
)
def status_preference(spark, sf):
    return sample.landing(spark, sf, COUNTY).chosen(COUNTY.scale).select(*grid.FILE_TAGS).distinct()


@register(
    "latest_by_rank",
    sql(
        """SELECT fips_code, variable, period_year, period_month, status, day_total, day_count FROM (
             SELECT *, rank() OVER (PARTITION BY fips_code, variable, period_year, period_month
                                    ORDER BY status DESC) AS rn
             FROM (SELECT fips_code, variable, period_year, period_month, status, sum(present) AS day_total,
                          count(present) AS day_count FROM obs GROUP BY ALL))
           WHERE rn = 1""",
        "obs",
    ),
)
def latest_by_rank(spark, sf):
    """Final readings per region, variable and month, preliminary ones where there are none."""
    keys = ["region_number", "variable_number", *MONTH]
    present = sample.drop_missing(F.col("reading"))
    chosen = cleaning.totals_of_best_status(sample.readings(spark, sf, COUNTY), keys, present)
    return sample.named(chosen, COUNTY).drop("status_rank").withColumnRenamed("region_code", "fips_code")


@register(
    "month_spine",
    """SELECT CAST(year(m) AS INTEGER) AS period_year, CAST(month(m) AS INTEGER) AS period_month
       FROM (SELECT unnest(generate_series(make_date(year(min(l_shipdate)), 1, 1)::TIMESTAMP,
                                           date_trunc('month', max(l_shipdate))::TIMESTAMP,
                                           INTERVAL 1 MONTH)) AS m FROM lineitem)""",
)
def month_spine(spark, sf):
    bounds = sample.table(spark, sf, "lineitem").agg(
        F.min("l_shipdate").alias("first"), F.to_date(F.max("l_shipdate")).alias("last")
    )
    return grid.month_spine(bounds, F.year("first"), F.year("last"), F.col("last"))


@register(
    "skipped_months",
    sql(
        """SELECT CAST(s.period_year AS INTEGER) AS period_year, CAST(s.period_month AS INTEGER) AS period_month
           FROM (SELECT year(m) AS period_year, month(m) AS period_month
                 FROM (SELECT unnest(generate_series(make_date(CAST(min(year(l_shipdate)) AS INTEGER), 1, 1)::TIMESTAMP,
                                                     make_date(CAST(max(year(l_shipdate)) AS INTEGER), 12, 1)::TIMESTAMP,
                                                     INTERVAL 1 MONTH)) AS m FROM lineitem)) s
           ANTI JOIN obs o ON s.period_year = o.period_year AND s.period_month = o.period_month""",
        "obs",
    ),
)
def skipped_months(spark, sf):
    """Months of the loaded years without a file of any status."""
    files = _listing(spark, sf, STATE)
    years = sample.table(spark, sf, "lineitem").agg(
        F.min(F.year("l_shipdate")).alias("first"), F.max(F.year("l_shipdate")).alias("last")
    )
    end = F.make_date(F.col("last"), F.lit(12), F.lit(31))
    return grid.months_without_files(grid.month_spine(years, F.col("first"), F.col("last"), end), files)


_LINE = "'ste,' || concat_ws(',', region_code, 'Region ' || region_code, period_year, period_month, variable, " + ", ".join(
    f"coalesce({name}, '')" for name in DAY_COLUMNS
) + ")"
_NAMES = ", ".join(f"'{name}'" for name in GRID_SCHEMA.fieldNames())


@register(
    "source_profile",
    sql(
        f"""SELECT * FROM (
            WITH line AS (SELECT region_code, {_LINE} AS value FROM ({_SCAN.format("state_days")})),
                 cell AS (SELECT value, string_split(value, ',') AS cells FROM line),
                 blank AS (SELECT name, count(*) FILTER (trim(coalesce(cells[i], '')) = '') AS n
                           FROM cell, (SELECT unnest([{_NAMES}]) AS name, unnest(range(1, {len(GRID_SCHEMA) + 1})) AS i) GROUP BY name)
            SELECT 'rows' AS section, '' AS name, CAST(count(*) AS VARCHAR) AS value FROM line
            UNION ALL SELECT 'columns', 'least', CAST(min(len(cells)) AS VARCHAR) FROM cell
            UNION ALL SELECT 'columns', 'most', CAST(max(len(cells)) AS VARCHAR) FROM cell
            UNION ALL SELECT 'codes', '', CAST(count(DISTINCT region_code) AS VARCHAR) FROM line
            UNION ALL SELECT 'blank cells', name, CAST(n AS VARCHAR) FROM blank
            UNION ALL SELECT 'unmatched code', region_code, CAST(count(*) AS VARCHAR) FROM line
                      ANTI JOIN xwalk USING (region_code) GROUP BY region_code
            UNION ALL SELECT 'first row', CAST(row_number() OVER (ORDER BY value) AS VARCHAR), value
                      FROM (SELECT value FROM line ORDER BY value LIMIT 5))""",
        "state_days",
        "xwalk",
    ),
)
def source_profile(spark, sf):
    lines = spark.read.text(sample.landed_folders(spark, sf, STATE), recursiveFileLookup=True)
    return grid.source_report(lines, crosswalk(spark))


@register(
    "source_probe",
    sql(
        f"""SELECT DISTINCT {_FILE_COLUMNS.format('ste')} FROM chosen
            WHERE variable = 'tavg' AND period_year = 2001 AND period_month = 9""",
        "chosen",
    ),
)
def source_probe(spark, sf):
    """In November the newest mean-temperature file looked for is that of September."""
    probed = grid.probe_files(_listing(spark, sf, STATE), F.lit("2001-11-30").cast("date"))
    return probed.select(*grid.FILE_TAGS).distinct()


_SAMPLE_VALUE = sql_r8("avg(reading) FILTER (reading > -900) * 9 / 5 + 32", "value")


@register(
    "profile_sort",
    sql(
        f"""SELECT state_abbr, period_year, period_month, {_SAMPLE_VALUE}
            FROM state_grid JOIN xwalk USING (region_code) WHERE variable = 'tavg'
            GROUP BY state_abbr, period_year, period_month ORDER BY state_abbr, period_year, period_month""",
        "state_grid",
        "xwalk",
    ),
)
def profile_sort(spark, sf):
    """The parsed mean temperatures, sorted by abbreviation."""
    rows = sample.landing(spark, sf, STATE).scan(STATE.scale, F.col("variable") == "tavg")
    folded = cleaning.fold_month(rows)
    parsed = cleaning.map_codes(folded, crosswalk(spark))
    return rounded(parsed.select("state_abbr", *MONTH, "value").orderBy("state_abbr", *MONTH), "value")


@register(
    "head_n",
    sql(
        f"""SELECT state_abbr, period_year, period_month, {_SAMPLE_VALUE}
            FROM state_grid JOIN xwalk USING (region_code) WHERE variable = 'tavg'
            GROUP BY state_abbr, period_year, period_month ORDER BY state_abbr, period_year, period_month LIMIT 50""",
        "state_grid",
        "xwalk",
    ),
)
def head_n(spark, sf):
    return profile_sort(spark, sf).limit(50)


SQL_GRID_PANEL = mart_from_grid("state_grid JOIN xwalk USING (region_code)", "state_fips, state_abbr")


@register(
    "monthly_from_daily",
    sql(
        f"SELECT state_fips, state_abbr, period_year, period_month, {SQL_MEASURES} FROM ({SQL_GRID_PANEL})",
        "state_grid",
        "xwalk",
    ),
)
def monthly_from_daily(spark, sf):
    return rounded(cleaning.monthly_from_grid(_scan(spark, sf, STATE), STATE, crosswalk(spark)), *MEASURE_COLUMNS)


@register(
    "monthly_from_daily_county",
    sql(
        f"""SELECT region_code AS fips_code, period_year, period_month, {SQL_MEASURES}
            FROM ({mart_from_grid("county_grid", "region_code")})""",
        "county_grid",
    ),
)
def monthly_from_daily_county(spark, sf):
    return rounded(cleaning.monthly_from_grid(_scan(spark, sf, COUNTY), COUNTY), *MEASURE_COLUMNS)


SQL_SOURCES = """SELECT period_year, period_month, string_agg(variable || '-' ||
      CAST(period_year * 100 + period_month AS VARCHAR) || '-ste-' || status || '.csv', ';'
      ORDER BY CASE variable WHEN 'tmax' THEN 1 WHEN 'tmin' THEN 2 WHEN 'tavg' THEN 3 ELSE 4 END) AS source_file
    FROM chosen GROUP BY period_year, period_month"""


@register(
    "provenance",
    sql(
        f"""SELECT state_fips, period_year, period_month, source_file
            FROM (SELECT DISTINCT state_fips, period_year, period_month FROM state_grid JOIN xwalk USING (region_code))
            JOIN ({SQL_SOURCES}) USING (period_year, period_month)""",
        "state_grid",
        "xwalk",
        "chosen",
    ),
)
def provenance(spark, sf):
    landing = sample.landing(spark, sf, STATE)
    sources = grid.provenance(landing.chosen(STATE.scale), "file_name")
    panel = cleaning.monthly_from_grid(landing.scan(STATE.scale), STATE, crosswalk(spark), sources)
    return panel.select("state_fips", *MONTH, "source_file")
