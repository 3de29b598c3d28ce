"""Wide daily grid files: one row per region, one text column per day, no header.

Variable, period, scale and status are told by the file name only. Any path part
may carry the name, so a file and a folder of part files are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrapanel.functions.values import probe_month
from terrapanel.refdata import MEASURES, STATUSES
from terrapanel.schemas import GRID_SCHEMA

FILE_NAME = r"((?:%s)-\d{6}-(?:ste|cty)-(?:%s)\.csv)" % ("|".join(MEASURES), "|".join(STATUSES))
FILE_TAGS = ["variable", "period_year", "period_month", "scale", "status", "status_rank", "file_name"]


def status_rank(status: Column) -> Column:
    """0 for the preferred status, larger for the ones that only fill in; an unknown one is last."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int")
    return F.when(place > 0, place - 1).otherwise(F.lit(len(STATUSES)))


def file_name(variable: Column, year: Column, month: Column, scale: Column, status: Column) -> Column:
    period = F.format_string("%04d%02d", year, month)
    return F.concat(F.concat_ws("-", variable, period, scale, status), F.lit(".csv"))


def with_file_tags(df: DataFrame, path: str = "path") -> DataFrame:
    """Add what the file name in path says."""
    others = [name for name in df.columns if name != path]
    named = df.select(*others, path, F.regexp_extract(path, FILE_NAME, 1).alias("file_name"))
    # The parts get a column of their own, so that the name is split once per row.
    split = named.select(*named.columns, F.split("file_name", "[-.]").alias("_parts"))
    part = F.col("_parts")
    return split.select(
        *named.columns,
        F.get(part, F.lit(0)).alias("variable"),
        F.substring(F.get(part, F.lit(1)), 1, 4).try_cast("int").alias("period_year"),
        F.substring(F.get(part, F.lit(1)), 5, 2).try_cast("int").alias("period_month"),
        F.get(part, F.lit(2)).alias("scale"),
        F.get(part, F.lit(3)).alias("status"),
        status_rank(F.get(part, F.lit(3))).alias("status_rank"),
    )


def _listing(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    return with_file_tags(files.load(root).select("path", "length"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per grid file below root, with its tags. File contents are not opened."""
    return _listing(spark, root).where(F.col("file_name") != "")


def unnamed_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root whose names say nothing; no load reads them, its report counts them."""
    return _listing(spark, root).where(F.col("file_name") == "").select("path", "length")


def location(path: Column, name: Column) -> Column:
    """Where a file lies: its path up to its name, so that the part files of one folder have one location."""
    return F.concat(F.substring(path, F.lit(1), F.instr(path, name) - 1), name)


def prefer_status(files: DataFrame) -> DataFrame:
    """Per variable and month keep the files of the best status present.

    Works on a file listing, whose groups are the part files of one month.
    """
    month = W.partitionBy("scale", "variable", "period_year", "period_month")
    return (
        files.withColumn("best_rank", F.min("status_rank").over(month))
        .where(F.col("status_rank") == F.col("best_rank"))
        .drop("best_rank")
    )


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Scan only the listed files. Collects their paths (file metadata, not rows)."""
    paths = [row.path for row in files.select("path").collect()]
    if not paths:
        grid = spark.createDataFrame([], GRID_SCHEMA).withColumn("path", F.lit(""))
    else:
        grid = spark.read.csv(paths, schema=GRID_SCHEMA, header=False)
        grid = grid.select("*", F.col("_metadata.file_path").alias("path"))
    return with_file_tags(grid)


def scan_grid(spark: SparkSession, root: str, scale: str) -> DataFrame:
    """All grid rows of one scale, superseded files left unread."""
    files = list_files(spark, root).where(F.col("scale") == scale)
    return read_files(spark, prefer_status(files))


def provenance(files: DataFrame, location: str = "path") -> DataFrame:
    """Per month, the ';'-joined sources in variable order."""
    order = F.array_position(F.array(*[F.lit(v) for v in MEASURES]), F.col("variable"))
    ordered = F.array_sort(F.collect_set(F.struct(order.alias("ord"), F.col(location).alias("name"))))
    return files.groupBy("period_year", "period_month").agg(
        F.array_join(F.transform(ordered, lambda item: item["name"]), ";").alias("source_file")
    )


def month_spine(bounds: DataFrame, start: Column, end: Column, as_of: Column) -> DataFrame:
    """Every (year, month) from January of the start year to December of the end year,
    not past the as_of month. bounds supplies the row the three columns are taken from."""
    first = F.make_date(start, F.lit(1), F.lit(1))
    last = F.least(F.make_date(end, F.lit(12), F.lit(1)), F.trunc(as_of, "month"))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    spine = bounds.select(F.explode(months).alias("period_date"))
    return spine.select(
        F.year("period_date").alias("period_year"), F.month("period_date").alias("period_month")
    )


def months_without_files(spine: DataFrame, files: DataFrame) -> DataFrame:
    return spine.join(files, ["period_year", "period_month"], "left_anti")


def in_refresh_scope(files: DataFrame, as_of: Column) -> DataFrame:
    """Files of the previous and the current year."""
    return files.where(refresh_scope(as_of))


def refresh_scope(as_of: Column) -> Column:
    return F.col("period_year").between(F.year(as_of) - 1, F.year(as_of))


def probe_files(files: DataFrame, as_of: Column, variable: str = "tavg") -> DataFrame:
    """The best files of one variable for the newest month expected to be out."""
    month = probe_month(as_of)
    probed = files.where(
        (F.col("variable") == variable)
        & (F.col("period_year") == F.year(month))
        & (F.col("period_month") == F.month(month))
    )
    return prefer_status(probed)


def profile_source(lines: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Shape of headerless text lines: rows, fewest and most columns, blank cells, codes not in the crosswalk."""
    cells = F.split("value", ",")
    shaped = lines.select(
        F.size(cells).alias("columns"),
        F.size(F.filter(cells, lambda c: F.trim(c) == "")).alias("blanks"),
        F.trim(cells[1]).alias("region_code"),
    ).join(crosswalk.select("region_code", F.lit(True).alias("known")), "region_code", "left")
    # Per code first: the distinct count below then sees one row per code.
    per_code = shaped.groupBy("region_code", "known").agg(
        F.count("*").alias("rows"),
        F.min("columns").alias("fewest"),
        F.max("columns").alias("most"),
        F.sum("blanks").alias("blanks"),
    )
    return per_code.agg(
        F.sum("rows").alias("row_count"),
        F.min("fewest").alias("min_columns"),
        F.max("most").alias("max_columns"),
        F.sum("blanks").alias("blank_cells"),
        F.count("*").alias("codes"),
        F.count_if(F.col("known").isNull()).alias("unmapped_codes"),
    )


PROFILE = ["section", "name", "value"]


def source_report(lines: DataFrame, crosswalk: DataFrame, first: int = 5, sketch: bool = False) -> DataFrame:
    """What headerless text lines hold, as rows (section, name, value): number of rows, fewest and most columns, blank cells of every
    column of the grid layout, region codes, each code that is not in the crosswalk with its rows, and the first lines in text order.

    Lines are parsed with the grid layout in one pass; cells and columns are totalled per code before they are moved, so
    the codes come from the same exchange. With sketch, codes are not grouped first and their number is an estimate (about 2%): for
    files whose code column holds anything.
    """
    names = GRID_SCHEMA.fieldNames()
    parsed = lines.select(
        F.from_csv("value", GRID_SCHEMA.simpleString()[len("struct<") : -1].replace(":", " ")).alias("row"),
        F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), ",")).alias("columns"),
    )
    code = F.trim("row.region_code").alias("region_code")
    blank = {n: F.count_if(F.coalesce(F.trim(f"row.{n}"), F.lit("")) == "") for n in names}
    shape = [F.count("*").alias("rows"), F.min("columns").alias("least"), F.max("columns").alias("most")]
    per_code = parsed.groupBy(code).agg(*shape, *[c.alias(f"blank_{n}") for n, c in blank.items()])
    if sketch:
        total = parsed.agg(
            *shape, F.approx_count_distinct(code, 0.02).alias("codes"), *[c.alias(f"blank_{n}") for n, c in blank.items()]
        )
    else:
        total = per_code.agg(
            F.sum("rows").alias("rows"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
            F.count("region_code").alias("codes"),
            *[F.sum(f"blank_{n}").alias(f"blank_{n}") for n in names],
        )

    def item(section: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    facts = [item("rows", F.lit(""), F.coalesce("rows", F.lit(0)))]
    facts += [item("columns", F.lit(n), F.col(n)) for n in ("least", "most")]
    facts += [item("codes", F.lit(""), F.col("codes"))]
    facts += [item("blank cells", F.lit(n), F.coalesce(f"blank_{n}", F.lit(0))) for n in names]
    report = total.select(F.inline(F.array(*facts)))
    unknown = per_code.join(crosswalk.select("region_code"), "region_code", "left_anti")
    report = report.unionByName(unknown.select(F.inline(F.array(item("unmatched code", F.col("region_code"), F.col("rows"))))))
    head = lines.orderBy("value").limit(first).agg(F.array_sort(F.collect_list("value")).alias("lines"))  # `first` lines
    return report.unionByName(
        head.select(F.posexplode("lines").alias("at", "line")).select(F.inline(F.array(item("first row", F.col("at") + 1, F.col("line")))))
    )
