"""Upserts, published tables and refreshes. These write to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators import quality, upsert
from terrapanel.operators.tables import YearTable, with_period
from terrapanel.plans import marts
from terrapanel.plans.population import add_abbreviation, in_scope
from terrapanel.registry import models
from terrapanel.registry.base import (
    ANNUAL_VALUES,
    MEASURE_COLUMNS,
    SQL_ANNUAL,
    SQL_MEASURES,
    register,
    rounded,
    sql,
)
from terrapanel.registry.scans import SQL_GRID_PANEL, SQL_SOURCES, mart_from_grid
from terrapanel.schemas import (
    COUNTY,
    KEYS,
    POPULATION_ANNUAL,
    RAW_COUNTY_MONTHLY,
    RAW_STATE_MONTHLY,
    STATE,
    conform,
)
from terrapanel.session import fresh_path
from terrapanel.sources import sample_tables as sample
from terrapanel.sources.daily_grid import file_name
from terrapanel.sources.landed_grid import FOLDERS, open_landing
from terrapanel.sources.regions import crosswalk, state_lookup
from terrapanel.streaming import refresh as refreshing

MONTH = ["period_year", "period_month"]
BUCKET_READINGS = 1_000_000  # of all years, in a bucket of the county table


def _panel_sql(region: str, where: str, join: str = "") -> str:
    def mean(variable: str) -> str:
        return f"avg(present) FILTER (variable = '{variable}') * 9 / 5 + 32"

    return f"""SELECT {region}, period_year, period_month, {mean("tmax")} AS tmax_f, {mean("tmin")} AS tmin_f,
                      {mean("tavg")} AS tavg_f, sum(present) FILTER (variable = 'prcp') / 25.4 AS prcp_in
               FROM obs {join} WHERE {where} GROUP BY {region}, period_year, period_month"""


def _upserted(region: str, key: str, join: str = "") -> str:
    columns = f"{region}, period_year, period_month, {SQL_MEASURES}, source_file"
    return f"""SELECT {columns} FROM (
        SELECT *, 'final' AS source_file FROM ({_panel_sql(region, "status = 'scaled'", join)})
        UNION ALL
        SELECT *, 'preliminary' FROM ({_panel_sql(region, "status = 'prelim'", join)}) o
        ANTI JOIN ({_panel_sql(region, "status = 'scaled'", join)}) n
        USING ({key}, period_year, period_month))"""


def _upsert_climate(spark, sf, panel, grain):
    """A preliminary panel on storage, then all final values on top."""
    table = fresh_path(spark, f"{grain.key}-monthly")
    keys = [grain.key, *MONTH]
    first = panel(spark, sf, status="prelim").withColumn("source_file", F.lit("preliminary"))
    upsert.upsert_table(table, first, keys)
    batch = panel(spark, sf, status="scaled").withColumn("source_file", F.lit("final"))
    upsert.upsert_table(table, batch, keys)
    stored = spark.read.parquet(table).select(*first.columns)
    return rounded(stored, *MEASURE_COLUMNS)


@register(
    "upsert_climate_state",
    sql(_upserted("state_fips, state_abbr", "state_fips", "JOIN xwalk USING (region_code)"), "obs", "xwalk"),
)
def upsert_climate_state(spark, sf):
    return _upsert_climate(spark, sf, sample.state_panel, STATE)


@register("upsert_climate_county", sql(_upserted("fips_code", "fips_code"), "obs"))
def upsert_climate_county(spark, sf):
    return _upsert_climate(spark, sf, sample.county_panel, COUNTY)


@register(
    "upsert_population",
    sql(
        """SELECT state_fips, period_year, coalesce(n.population, o.population) AS population,
                  coalesce(n.source, o.source) AS source,
                  CASE WHEN o.state_fips IS NULL THEN lower(state_abbr) ELSE state_abbr END AS state_abbr,
                  CASE WHEN n.state_fips IS NULL THEN DATE '2001-01-01' ELSE DATE '2002-01-01' END AS ingested_at
           FROM (SELECT * FROM old_pop SEMI JOIN xwalk USING (state_fips)) o
           FULL JOIN (SELECT * FROM new_pop SEMI JOIN xwalk USING (state_fips)) n USING (state_fips, period_year)
           JOIN xwalk USING (state_fips)""",
        "old_pop",
        "new_pop",
        "xwalk",
    ),
)
def upsert_population(spark, sf):
    """The batch spells the abbreviation differently; known rows keep theirs."""
    lookup = state_lookup(spark)

    def dated(df, day):
        labelled = add_abbreviation(in_scope(df, lookup), lookup)
        return conform(labelled.withColumn("ingested_at", F.lit(day)), POPULATION_ANNUAL)

    table = fresh_path(spark, "population")
    keys = KEYS["population_annual"]
    upsert.upsert_table(table, dated(models.old_population(spark, sf), "2001-01-01"), keys)
    batch = dated(models.new_population(spark, sf), "2002-01-01")
    batch = batch.withColumn("state_abbr", F.lower("state_abbr"))
    upsert.upsert_table(table, batch, keys, updates=["population", "source", "ingested_at"])
    return spark.read.parquet(table)


@register("materialize", sql(f"SELECT {SQL_ANNUAL} FROM annual", "annual"))
def materialize(spark, sf):
    """Staging as a view, the annual mart as a table at rest, read back."""
    tag = uuid.uuid4().hex
    staged = upsert.publish_view(models.staged(spark, sf), f"staging_climate_{tag}")
    annual = marts.mart_annual(marts.anomaly_by_region(staged, 1996, 1998))
    table = upsert.publish_table(annual, f"mart_annual_{tag}", fresh_path(spark, "mart_annual"), "period_year", ["state_fips"])
    return rounded(table, *ANNUAL_VALUES)


@register(
    "raw_schema",
    sql(
        """SELECT state_fips, state_abbr, period_year, period_month,
                  max(present) FILTER (variable = 'tmax') AS tmax_f,
                  min(present) FILTER (variable = 'tmin') AS tmin_f,
                  max(present) FILTER (variable = 'tavg') AS tavg_f,
                  max(present) FILTER (variable = 'prcp') AS prcp_in,
                  'lineitem' AS source_file, DATE '2002-01-01' AS ingested_at
           FROM obs JOIN xwalk USING (region_code) GROUP BY ALL""",
        "obs",
        "xwalk",
    ),
)
def raw_schema(spark, sf):
    """Extremes per month in the raw table's layout; a month without a variable has a typed null."""
    present = sample.drop_missing(F.col("reading"))

    def of(number):
        return F.when(F.col("variable_number") == number, present)

    extremes = sample.readings(spark, sf).groupBy("region_number", *MONTH).agg(
        F.max(of(0)).alias("tmax_f"),
        F.min(of(1)).alias("tmin_f"),
        F.max(of(2)).alias("tavg_f"),
        F.max(of(3)).alias("prcp_in"),
    )
    known = sample.named(extremes, STATE).join(crosswalk(spark), "region_code")
    raw = known.withColumns({"source_file": F.lit("lineitem"), "ingested_at": F.lit("2002-01-01")})
    table = conform(raw, RAW_STATE_MONTHLY).drop("status_rank")
    return table.withColumns({m: F.col(m).cast("double") for m in MEASURE_COLUMNS})


# ---- refresh ---------------------------------------------------------------

_DECIMALS = ", ".join(
    f"CAST(CAST(CAST(round({m}, 8) AS VARCHAR) AS DECIMAL(6, 2)) AS DOUBLE) AS {m}" for m in MEASURE_COLUMNS
)
_LOADED = f"""SELECT state_fips, state_abbr, period_year, period_month, {_DECIMALS}, source_file,
                     DATE '2001-11-30' AS ingested_at
              FROM ({SQL_GRID_PANEL}) JOIN ({SQL_SOURCES}) USING (period_year, period_month)"""


def _stored_panel(spark, table):
    """The raw table as stored, its sources by the names of the files and not by their folders."""
    columns = ["state_fips", "state_abbr", *MONTH, *MEASURE_COLUMNS, "source_file", "ingested_at"]
    stored = spark.read.parquet(table).withColumns({m: F.col(m).cast("double") for m in MEASURE_COLUMNS})

    def name(place):
        step = {n: F.regexp_extract(place, f"/{n}=([^/]+)", 1) for n in FOLDERS.fieldNames()}
        numbers = [step[n].cast("int") for n in ("period_year", "period_month")]
        return file_name(step["variable"], *numbers, step["scale"], step["status"])

    names = F.array_join(F.transform(F.split("source_file", ";"), name), ";")
    return stored.withColumn("source_file", names).select(*columns)


@register("refresh_scope", sql(_LOADED + " WHERE period_year >= 2000", "state_grid", "xwalk", "chosen"))
def refresh_scope(spark, sf):
    """A run in November 2001 loads 2000 and 2001."""
    table = fresh_path(spark, "refreshed")
    as_of = F.lit("2001-11-30").cast("date")
    refreshing.refresh(spark, sample.landing(spark, sf, STATE), table, as_of)
    return _stored_panel(spark, table)


@register(
    "refresh_population",
    sql("SELECT *, DATE '2001-11-30' AS ingested_at FROM pop", "pop"),
)
def refresh_population(spark, sf):
    """The population sources are always loaded in full; loading them twice changes nothing."""
    table = fresh_path(spark, "population")
    loaded_on = F.lit("2001-11-30").cast("date")
    for _ in range(2):
        refreshing.refresh_population(
            models.old_population(spark, sf), models.new_population(spark, sf), table, loaded_on
        )
    return spark.read.parquet(table)


@register("arrival_stream", sql(_LOADED, "state_grid", "xwalk", "chosen"))
def arrival_stream(spark, sf):
    """All landed files picked up in several batches by a file stream that ends when none is left."""
    table = fresh_path(spark, "streamed")
    loaded_on = F.lit("2001-11-30").cast("date")
    query = refreshing.stream_arrivals(
        spark,
        open_landing(spark, sample.landed_folders(spark, sf, STATE), discover=False),
        table,
        fresh_path(spark, "stream-checkpoint"),
        files_per_batch=400,
        loaded_on=loaded_on,
    )
    query.awaitTermination()
    return _stored_panel(spark, table)


@register(
    "prelim_to_scaled_revision",
    sql(
        f"""SELECT region_code AS fips_code, period_year, period_month, {_DECIMALS}, CAST(status_rank AS INTEGER) AS status_rank FROM (
            WITH early AS (SELECT * FROM county_days WHERE status = 'prelim'),
                 one AS ({mart_from_grid("early", "region_code")}),
                 two AS ({mart_from_grid("county_grid", "region_code")}),
                 ranks AS (SELECT period_year, period_month, min(CASE status WHEN 'scaled' THEN 0 ELSE 1 END) AS status_rank
                           FROM chosen GROUP BY ALL)
            SELECT two.*, status_rank FROM two JOIN ranks USING (period_year, period_month)
            UNION ALL
            SELECT one.*, 1 FROM one ANTI JOIN two USING (region_code, period_year, period_month))""",
        "county_days",
        "county_grid",
        "chosen",
    ),
)
def prelim_to_scaled_revision(spark, sf):
    """Files of three arrivals into a bucketed county table: preliminary ones, then all (best status first), then preliminary ones
    again, which change nothing."""
    landing = sample.landing(spark, sf, COUNTY)
    schema = T.StructType([*RAW_COUNTY_MONTHLY, T.StructField("period", T.IntegerType())])
    name = f"raw_county_{uuid.uuid4().hex}"
    # a merge's task holds one bucket of all touched years
    buckets = max(16, -(-sample.table(spark, sf, "lineitem").count() // BUCKET_READINGS))
    table = YearTable(spark, name, fresh_path(spark, "raw_county"), ("fips_code", "period"), buckets=buckets).create(schema)
    loaded_on = F.lit("2001-11-30").cast("date")
    found = landing.partitions().where(F.col("scale") == COUNTY.scale)
    early = F.col("status") == "prelim"
    rows = spark.table(landing.name).where(F.col("scale") == COUNTY.scale)
    preliminary = refreshing.raw_batch(rows.where(early), found.where(early), COUNTY, loaded_on)
    best = refreshing.raw_batch(landing.scan(COUNTY.scale), landing.chosen(COUNTY.scale), COUNTY, loaded_on)
    for batch in (preliminary, best, preliminary):
        table.merge(with_period(batch), rank="status_rank")
    columns = ["fips_code", *MONTH, *MEASURE_COLUMNS, "status_rank"]
    return table.read().withColumns({m: F.col(m).cast("double") for m in MEASURE_COLUMNS}).select(*columns)


@register(
    "load_report",
    sql(
        """SELECT * FROM (WITH spine AS (
             SELECT year(m) AS period_year, month(m) AS period_month FROM (SELECT unnest(generate_series(
               DATE '1999-01-01'::TIMESTAMP, DATE '2001-11-01'::TIMESTAMP, INTERVAL 1 MONTH)) AS m)),
           held AS (SELECT DISTINCT period_year, period_month, variable FROM obs WHERE period_year >= 1999)
           SELECT 'variable without a file' AS item,
                  printf('%04d-%02d %s', m.period_year, m.period_month, v.variable) AS detail, CAST(1 AS BIGINT) AS n
           FROM (SELECT DISTINCT period_year, period_month FROM held) m,
                (VALUES ('tmax'), ('tmin'), ('tavg'), ('prcp')) AS v(variable)
           ANTI JOIN held ON held.period_year = m.period_year AND held.period_month = m.period_month
                             AND held.variable = v.variable
           UNION ALL
           SELECT 'month without files', printf('%04d-%02d', s.period_year, s.period_month), 1 FROM spine s
           ANTI JOIN held ON held.period_year = s.period_year AND held.period_month = s.period_month
           UNION ALL
           SELECT 'rows of an unknown region code', region_code, count(*)
           FROM (SELECT DISTINCT region_code, variable, period_year, period_month FROM state_grid)
           WHERE period_year >= 1999 AND region_code NOT IN (SELECT region_code FROM xwalk) GROUP BY region_code
           UNION ALL
           SELECT 'rows written', 'table', count(*)
           FROM (SELECT DISTINCT region_code, period_year, period_month FROM state_grid)
           WHERE period_year >= 1999 AND region_code IN (SELECT region_code FROM xwalk))""",
        "obs",
        "state_grid",
        "xwalk",
    ),
)
def load_report(spark, sf):
    """What a backfill of 1999 to November 2001 left out, and the rows it wrote."""
    as_of = F.lit("2001-11-30").cast("date")
    landing = sample.landing(spark, sf, STATE)
    report = refreshing.backfill(spark, landing, fresh_path(spark, "backfilled"), 1999, 2001, as_of)
    return report.withColumn("detail", F.when(F.col("item") == "rows written", "table").otherwise(F.col("detail")))


@register(
    "raw_domain_check",
    sql(
        """SELECT 'domain' AS rule, 'raw_state_monthly' AS table_name,
                  unnest(['month_in_year', 'tmax_above_tmin', 'source_named']) AS subject,
                  unnest([count(*) FILTER (period_month NOT BETWEEN 1 AND 12),
                          count(*) FILTER (coalesce(tmax_f < tmin_f, true)),
                          count(*) FILTER (source_file IS NULL)]) AS failing_rows
           FROM ("""
        + _LOADED
        + """ WHERE period_year >= 2000)""",
        "state_grid",
        "xwalk",
        "chosen",
    ),
)
def raw_domain_check(spark, sf):
    """Rules on the raw table as a refresh stored it."""
    table = fresh_path(spark, "refreshed")
    as_of = F.lit("2001-11-30").cast("date")
    refreshing.refresh(spark, sample.landing(spark, sf, STATE), table, as_of)
    rules = {
        "month_in_year": F.col("period_month").between(1, 12),
        "tmax_above_tmin": F.col("tmax_f") >= F.col("tmin_f"),
        "source_named": F.col("source_file").isNotNull(),
    }
    return quality.domain_check(spark.read.parquet(table), "raw_state_monthly", rules)
