"""The given tables read as panel inputs.

Each lineitem row is one daily reading: the supplier names the region, the line
number the variable, the line status whether it is final, and a zero tax marks the
reading as missing. Orders count as population. Every adapter reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.values import celsius_to_fahrenheit, drop_missing, mm_to_inches, pad_key
from terrapanel.refdata import MEASURES, STATUSES, SUMMED
from terrapanel.schemas import COUNTY, DAY_COLUMNS, STATE, Grain
from terrapanel.session import landed_once
from terrapanel.sources.landed_grid import Landing, land, open_landing
from terrapanel.sources.daily_grid import file_name
from terrapanel.sources.regions import crosswalk

MISSING_MARK = -999.99
# Source codes 49 and 50 stand for regions the crosswalk does not know.
SOURCE_REGIONS = 50
FIPS_CODES = 56
# From this month on only preliminary files are out.
PRELIMINARY_SINCE = 200107
# Old population codes: 2 is 1995, so the first year is dropped.
SAMPLE_YEAR_ZERO = 1993
OVERLAP_YEAR = 1998
VINTAGES = ["1998-2001", "1998-2000"]

# Of county readings, which are nearly as many as their grid rows: how many a task and a landed file take.
TASK_READINGS = 400_000
FILE_READINGS = 200_000

_LINES = {"tmax": (1, 2), "tmin": (3, 4), "tavg": (5, 6), "prcp": (7, 7)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _variable_number() -> Column:
    branches = F
    for number, (first, last) in enumerate(_LINES.values()):
        branches = branches.when(F.col("l_linenumber").between(first, last), F.lit(number))
    return branches


def region_number(grain: Grain) -> Column:
    return F.col("l_suppkey") % SOURCE_REGIONS + 1 if grain == STATE else F.col("l_suppkey")


def readings(spark: SparkSession, sf: str, grain: Grain = STATE) -> DataFrame:
    """One row per reading, marker values still in.

    Region, variable and status are numbers, which are cheaper to group by than
    their names; named() puts the names in after the aggregate.
    """
    day = F.col("l_shipdate")
    year, month = F.year(day), F.month(day)
    published = year * 100 + month < PRELIMINARY_SINCE
    return table(spark, sf, "lineitem").select(
        region_number(grain).alias("region_number"),
        _variable_number().alias("variable_number"),
        year.alias("period_year"),
        month.alias("period_month"),
        F.dayofmonth(day).alias("period_day"),
        F.when(published & (F.col("l_linestatus") == "F"), 0).otherwise(1).alias("status_rank"),
        F.when(F.col("l_tax") == 0, F.lit(MISSING_MARK)).otherwise(F.col("l_quantity")).alias("reading"),
    )


def _pick(names, number: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in names]), number)


def named(df: DataFrame, grain: Grain) -> DataFrame:
    """Replace the numbers of readings() by codes and names, where present."""
    df = df.withColumn("region_code", pad_key(F.col("region_number"), grain.code_width)).drop("region_number")
    if "variable_number" in df.columns:
        df = df.withColumn("variable", _pick(_LINES, F.col("variable_number"))).drop("variable_number")
    if "status_rank" in df.columns:
        df = df.withColumn("status", _pick(STATUSES, F.col("status_rank")))
    return df


def monthly_long(spark: SparkSession, sf: str, grain: Grain, *extra: str) -> DataFrame:
    """Total and count of the readings present per region, variable and month."""
    present = drop_missing(F.col("reading"))
    keys = ["region_number", "variable_number", "period_year", "period_month", *extra]
    totals = readings(spark, sf, grain).groupBy(*keys).agg(
        F.sum(present).alias("day_total"), F.count(present).alias("day_count")
    )
    return named(totals, grain)


def _monthly(
    spark: SparkSession, sf: str, grain: Grain, status: str | None = None
) -> DataFrame:
    """The monthly panel by region number: every reading of a month, or only those of one status."""
    rows = readings(spark, sf, grain)
    if status is not None:
        rows = rows.where(F.col("status_rank") == STATUSES.index(status))
    present = drop_missing(F.col("reading"))

    def measure(number: int, variable: str) -> Column:
        mine = F.when(F.col("variable_number") == number, present)
        return mm_to_inches(F.sum(mine)) if variable in SUMMED else celsius_to_fahrenheit(F.avg(mine))

    return rows.groupBy("region_number", "period_year", "period_month").agg(
        *[measure(number, variable).alias(MEASURES[variable]) for number, variable in enumerate(_LINES)]
    )


def monthly_codes(spark: SparkSession, sf: str, grain: Grain) -> DataFrame:
    return named(_monthly(spark, sf, grain), grain)


def state_panel(spark: SparkSession, sf: str, **chosen) -> DataFrame:
    # Joined on the number: on the text, Spark would test it for null in every raw row.
    states = crosswalk(spark).select(
        F.col("region_code").cast("long").alias("region_number"), "state_fips", "state_abbr"
    )
    return _monthly(spark, sf, STATE, **chosen).join(states, "region_number").drop("region_number")


def county_panel(spark: SparkSession, sf: str, **chosen) -> DataFrame:
    panel = named(_monthly(spark, sf, COUNTY, **chosen), COUNTY)
    return panel.withColumnRenamed("region_code", "fips_code")


def placed_readings(rows: DataFrame) -> DataFrame:
    """Readings by the file they go to, of which a large one is divided by region (part), in as many partitions as they need. Runs a job.

    Moved like this a reading is a few numbers, as a grid row of its own a column for each day. Collects the large files' numbers
    of parts: at most one row for each variable, month and status.
    """
    spark, file = rows.sparkSession, ["variable_number", "period_year", "period_month", "status_rank"]
    parts = F.ceil(F.col("n") / FILE_READINGS).cast("int").alias("parts")
    counted = rows.groupBy(*file).agg(F.count("*").alias("n")).select(*[F.col(c).cast("int") for c in file], "n", parts).collect()
    values = [[r[c] for c in (*file, "parts")] for r in counted if r.parts > 1] or [[0, 0, 0, 0, 1]]
    texts = ["(" + ", ".join("NULL" if v is None else str(v) for v in row) + ")" for row in values]
    # literal rows, whose size Spark knows
    large = spark.sql(f"SELECT * FROM VALUES {', '.join(texts)} AS t({', '.join(f'{c}_' for c in file)}, parts)")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in file]
    part = F.pmod(F.xxhash64("region_number"), F.coalesce("parts", F.lit(1))).alias("part")
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r.n for r in counted) // TASK_READINGS))
    return rows.join(large, same, "left").select(*rows.columns, part).repartition(tasks, *file, "part")


def grid_rows(spark: SparkSession, sf: str, grain: Grain, placed: bool = False) -> DataFrame:
    """Wide text rows as the grid files hold them, plus the name of the file each belongs to. With placed, they lie by file."""
    days = [
        F.max(F.when(F.col("period_day") == number, F.col("reading"))).alias(name)
        for number, name in enumerate(DAY_COLUMNS, 1)
    ]
    keys = ["region_number", "variable_number", "period_year", "period_month", "status_rank"]
    rows = readings(spark, sf, grain)
    if placed:
        wide = named(placed_readings(rows).groupBy(*keys, "part").agg(*days), grain)
    else:
        wide = named(rows.groupBy(*keys).agg(*days), grain)
    scale = F.lit(grain.scale)
    return wide.select(
        file_name(F.col("variable"), F.col("period_year"), F.col("period_month"), scale, F.col("status")).alias("file"),
        scale.alias("region_type"),
        "region_code",
        F.concat(F.lit("Region "), "region_code").alias("region_name"),
        F.col("period_year").cast("string").alias("file_year"),
        F.col("period_month").cast("string").alias("file_month"),
        F.col("variable").alias("file_variable"),
        *[F.concat(F.lit(" "), F.col(name).cast("string")).alias(name) for name in DAY_COLUMNS],
    )


def landed_grid(spark: SparkSession, sf: str, grain: Grain) -> str:
    def write(path: str) -> None:
        (
            grid_rows(spark, sf, grain)
            .hint("rebalance", "file")
            .write.partitionBy("file")
            .option("ignoreLeadingWhiteSpace", "false")
            .csv(path)
        )

    return landed_once(spark, f"grid-{grain.scale}", sf, write)


def landed_folders(spark: SparkSession, sf: str, grain: Grain) -> str:
    """The same rows landed in folders by scale, month, variable and status."""

    def write(path: str) -> None:
        name = F.split(F.regexp_replace("file", r"\.csv$", ""), "-")
        values = {
            "scale": F.col("region_type"),
            "period_year": F.col("file_year").cast("int"),
            "period_month": F.col("file_month").cast("int"),
            "variable": F.col("file_variable"),
            "status": name[3],
        }
        # States are few: totalled before they are moved, their rows are fewer than the readings.
        placed = grain == COUNTY
        land(grid_rows(spark, sf, grain, placed).withColumns(values), path, placed)

    return landed_once(spark, f"folders-{grain.scale}", sf, write)


def landing(spark: SparkSession, sf: str, grain: Grain) -> Landing:
    """The landed folders in the session's catalog; listed the first time only."""
    opened = open_landing(spark, landed_folders(spark, sf, grain), discover=False)
    if spark.sql(f"SHOW PARTITIONS {opened.name}").isEmpty():
        opened.discover()
    return opened


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per FIPS-like region and year, all and open ones."""
    year = F.year("o_orderdate")
    counts = table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % FIPS_CODES + 1).alias("region"), year.alias("period_year")
    )
    return counts.agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("open_orders")
    )


def landed_json(spark: SparkSession, sf: str) -> str:
    """The old source: one document per region, each with its header row."""

    def write(path: str) -> None:
        counts = order_counts(spark, sf).where(F.col("period_year") <= OVERLAP_YEAR)
        row = F.array(
            F.concat(F.lit("Region "), F.col("region").cast("string")),
            F.col("orders").cast("string"),
            (F.col("period_year") - SAMPLE_YEAR_ZERO).cast("string"),
            F.col("region").cast("string"),
        )
        header = F.array(F.array(*[F.lit(c) for c in ("NAME", "POP", "DATE_CODE", "state")]))
        documents = counts.groupBy("region").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        # One document per file, since a document is read as a whole text.
        (
            documents.select("region", F.to_json(F.concat(header, "rows")).alias("value"))
            .hint("rebalance", "region")
            .write.partitionBy("region")
            .option("lineSep", "\n")
            .text(path)
        )

    return landed_once(spark, "old-population", sf, write)


def landed_wide_csv(spark: SparkSession, sf: str) -> str:
    """The new source in two vintages: a row per region, a column per year, and one total row."""

    def write(path: str) -> None:
        counts = order_counts(spark, sf).where(F.col("period_year") >= OVERLAP_YEAR)
        for vintage in VINTAGES:
            first, last = (int(year) for year in vintage.split("-"))
            columns = [
                F.coalesce(
                    F.sum(F.when(F.col("period_year") == year, F.col("orders") + F.col("open_orders"))), F.lit(0)
                ).alias(f"POPESTIMATE{year}")
                for year in range(first, last + 1)
            ]
            rows = counts.groupBy(F.lit("40").alias("SUMLEV"), F.col("region").cast("string").alias("STATE"))
            total = counts.groupBy(F.lit("10").alias("SUMLEV"), F.lit("0").alias("STATE"))
            both = rows.agg(*columns).unionByName(total.agg(*columns))
            both.write.option("header", "true").csv(f"{path}/{vintage}")

    return landed_once(spark, "new-population", sf, write)


def counties(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the county list."""
    suppliers = table(spark, sf, "supplier").select(
        pad_key(F.col("s_suppkey"), 5).alias("fips_code"),
        F.col("s_name").alias("county_name"),
        F.abs("s_acctbal").cast("decimal(10,2)").alias("land_sq_mi"),
        pad_key(F.col("s_nationkey") + 1, 2).alias("region_code"),
    )
    return suppliers.join(crosswalk(spark), "region_code")


def coded_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by a source code that the crosswalk knows in four of five cases."""
    return table(spark, sf, "events").select(
        pad_key(F.col("user_id") % 60 + 1, 2).alias("region_code"),
        "event_type",
        F.to_date("ts").alias("event_date"),
    )
