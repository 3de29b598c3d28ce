"""Bounded refresh of the raw panel, as a batch and as a file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapanel.operators.cleaning import monthly_from_grid, unmapped
from terrapanel.operators.quality import unmapped_report
from terrapanel.operators.upsert import upsert_table
from terrapanel.plans.population import population_long
from terrapanel.refdata import MEASURES
from terrapanel.schemas import (
    KEYS,
    POPULATION_ANNUAL,
    RAW_COUNTY_MONTHLY,
    RAW_STATE_MONTHLY,
    STATE,
    Grain,
    conform,
)
from terrapanel.session import staged
from terrapanel.sources.daily_grid import (
    in_refresh_scope,
    list_files,
    location,
    month_spine,
    months_without_files,
    prefer_status,
    provenance,
    read_files,
    refresh_scope,
    with_file_tags,
)
from terrapanel.sources.file_memory import batch_name, in_months, months_of, remember, remembered
from terrapanel.sources.landed_grid import Landing, with_folder_tags
from terrapanel.sources.regions import crosswalk, state_lookup


REPORT = ["item", "detail", "n"]


def load_report(chosen: DataFrame, grid: DataFrame, spine: DataFrame, grain: Grain, known: DataFrame) -> DataFrame:
    """What a load leaves out, as rows (item, detail, n): grid rows of unknown codes by code (state grain), variables
    without a file by month, months without any file."""

    def rows(df: DataFrame, item: str, detail: Column, n: Column) -> DataFrame:
        return df.select(F.lit(item).alias("item"), detail.cast("string").alias("detail"), n.cast("long").alias("n"))

    month = F.format_string("%04d-%02d", "period_year", "period_month")
    variables = F.array(*[F.lit(v) for v in MEASURES])
    held = chosen.groupBy("period_year", "period_month").agg(F.collect_set("variable").alias("held"))
    lacking = held.select("*", F.explode(F.array_except(variables, "held")).alias("variable"))
    report = rows(lacking, "variable without a file", F.concat_ws(" ", month, "variable"), F.lit(1))
    report = report.unionByName(rows(months_without_files(spine, chosen), "month without files", month, F.lit(1)))
    if grain == STATE:
        dropped = unmapped_report(unmapped(grid.select("region_code"), known))
        report = report.unionByName(
            rows(dropped, "rows of an unknown region code", F.col("region_code"), F.col("dropped_rows"))
        )
    return report


def load_files(
    files: DataFrame,
    table: str,
    grain: Grain = STATE,
    loaded_on: Column | None = None,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Listed flat files of the best status to the raw monthly table, see load_grid. Collects the paths to be read."""
    spark = files.sparkSession
    chosen = staged(prefer_status(files.where(F.col("scale") == grain.scale)), "chosen_files")
    place = location(F.col("path"), F.col("file_name"))
    return load_grid(read_files(spark, chosen), chosen.withColumn("location", place), table, grain, loaded_on, spine)


def load_landed(
    landing: Landing,
    table: str,
    grain: Grain = STATE,
    loaded_on: Column | None = None,
    spine: DataFrame | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Landed folders of the best status to the raw monthly table, see load_grid. `wanted` is a predicate on folder values: what it excludes
    is neither listed nor read, and no path is collected."""
    chosen = landing.chosen(grain.scale, wanted)
    return load_grid(landing.scan(grain.scale, wanted), chosen, table, grain, loaded_on, spine)


def load_grid(
    grid: DataFrame,
    chosen: DataFrame,
    table: str,
    grain: Grain = STATE,
    loaded_on: Column | None = None,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Grid rows to the raw monthly table, upserted in its layout. `chosen` tells the files or folders they come from. Runs jobs.

    The best status rank of a month's files is stored with its rows, so that a month known from preliminary files alone
    never replaces one with a final file, wherever that file is by then. Returns the load's report, written to the shared folder: what
    load_report names, for the months of the spine (those of the files if not given), and the rows written.
    """
    spark, known = grid.sparkSession, crosswalk(grid.sparkSession)
    batch = raw_batch(grid, chosen, grain, F.current_date() if loaded_on is None else loaded_on)
    written = upsert_table(table, batch, [grain.key, "period_year", "period_month"], rank="status_rank")
    if spine is None:
        spine = chosen.select("period_year", "period_month").distinct()
    total = spark.range(1).select(
        F.lit("rows written").alias("item"), F.lit(table).alias("detail"), F.lit(written).cast("long").alias("n")
    )
    return staged(load_report(chosen, grid, spine, grain, known).unionByName(total), "load_report")


def raw_batch(grid: DataFrame, chosen: DataFrame, grain: Grain, loaded_on: Column) -> DataFrame:
    """The months of grid rows in the raw table's layout, with sources and the best status rank of each month."""
    panel = monthly_from_grid(grid, grain, crosswalk(grid.sparkSession), provenance(chosen, "location"))
    ranks = chosen.groupBy("period_year", "period_month").agg(F.min("status_rank").alias("status_rank"))
    panel = panel.join(ranks, ["period_year", "period_month"], "left").withColumn("ingested_at", loaded_on)
    layout = RAW_STATE_MONTHLY if grain == STATE else RAW_COUNTY_MONTHLY
    # Sums of doubles end in noise, which must not decide how a tie is rounded.
    return conform(panel.withColumns({m: F.round(m, 8) for m in MEASURES.values()}), layout)


def refresh(spark: SparkSession, landing: str | Landing, table: str, as_of: Column, grain: Grain = STATE) -> DataFrame:
    """Re-load the previous and the current year, picking up new months and revisions. Returns the load's report.

    Of a Landing only these two years' folders are listed and read; a flat folder given by its path is listed whole."""
    spine = month_spine(spark.range(1), F.year(as_of) - 1, F.year(as_of), as_of)
    if isinstance(landing, Landing):
        return load_landed(landing, table, grain, as_of, spine, refresh_scope(as_of))
    return load_files(in_refresh_scope(list_files(spark, landing), as_of), table, grain, as_of, spine)


def backfill(
    spark: SparkSession, landing: str | Landing, table: str, start: int, end: int, as_of: Column, grain: Grain = STATE
) -> DataFrame:
    """Load every month of the years, not past as_of. Returns the load's report."""
    spine = month_spine(spark.range(1), F.lit(start), F.lit(end), as_of)
    wanted = F.col("period_year").between(start, end)
    if isinstance(landing, Landing):
        return load_landed(landing, table, grain, as_of, spine, wanted)
    return load_files(list_files(spark, landing).where(wanted), table, grain, as_of, spine)


def refresh_population(old: DataFrame, new: DataFrame, table: str, loaded_on: Column) -> None:
    """Both population sources in full, upserted; abbreviations already stored are kept. Runs jobs."""
    annual = population_long(old, new, state_lookup(old.sparkSession))
    batch = conform(annual.withColumn("ingested_at", loaded_on), POPULATION_ANNUAL)
    upsert_table(
        table, batch, KEYS["population_annual"], updates=["population", "source", "ingested_at"]
    )


def stream_arrivals(
    spark: SparkSession,
    landing: str | Landing,
    table: str,
    checkpoint: str,
    grain: Grain = STATE,
    files_per_batch: int = 1000,
    loaded_on: Column | None = None,
    memory: str | None = None,
) -> StreamingQuery:
    """Pick up every new file once and bring its month up to date.

    A batch adds its files to the stored list at `memory` (beside the checkpoint unless given), which tells what else is known of the
    months it touches. These are rebuilt from the list; no batch lists the landing folder, which the source has done once when it
    started. Rows of a better status already stored stay, so a late preliminary file cannot replace a final one, and
    a repeated batch gives the same table.
    """
    landed = isinstance(landing, Landing)
    root = landing.root if landed else landing
    memory = memory or f"{checkpoint.rstrip('/')}-files"
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path")
    )

    def bring_up_to_date(batch: DataFrame, number: int) -> None:
        # The load runs on the outer session, which unlike the stream's keeps adaptive execution.
        name = batch_name(checkpoint, number)
        tagged = with_folder_tags(batch) if landed else with_file_tags(batch)
        remember(tagged.where(F.col("file_name") != ""), memory, name)
        months = months_of(spark, memory, name)
        if not months:
            return
        known = remembered(spark, memory).where(in_months(months))
        if landed:
            landing.add(known)
            load_landed(landing, table, grain, loaded_on, wanted=in_months(months))
        else:
            load_files(known, table, grain, loaded_on)

    return (
        arrivals.writeStream.foreachBatch(bring_up_to_date)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
