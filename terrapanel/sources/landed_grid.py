"""Daily grid files landed in folders by what their names say.

scale=/period_year=/period_month=/variable=/status= above part files. What a file holds is then a partition value: years,
variables and statuses are pruned before any file is opened, and no row repeats the work of reading a name. Which
partitions there are is asked of the catalog, which lists folders; their number follows the calendar, not the bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.refdata import STATUSES
from terrapanel.schemas import GRID_SCHEMA
from terrapanel.sources.daily_grid import file_name, status_rank

FOLDERS = T.StructType(
    [
        T.StructField("scale", T.StringType()),
        T.StructField("period_year", T.IntegerType()),
        T.StructField("period_month", T.IntegerType()),
        T.StructField("variable", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
MONTH_OF_VARIABLE = ["scale", "period_year", "period_month", "variable"]


def land(grid: DataFrame, root: str, placed: bool = False) -> None:
    """Write grid rows that carry the folder columns, several files for a large month. Runs a job. Rows that already lie by folder
    are written from where they are."""
    names = FOLDERS.fieldNames()
    rows = grid.select(*GRID_SCHEMA.fieldNames(), *names)
    laid_out = rows if placed else rows.hint("rebalance", *names)
    laid_out.write.partitionBy(*names).option("ignoreLeadingWhiteSpace", "false").csv(root)


@dataclass(frozen=True)
class Landing:
    """Landed folders as a table of the session's catalog, which knows what there is without listing. `open_landing` makes one."""

    spark: SparkSession
    root: str
    name: str

    def discover(self) -> None:
        """Let the catalog know all folders there are. Lists them."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self.spark.sql(f"REFRESH TABLE {self.name}")

    def add(self, folders: DataFrame) -> None:
        """Let the catalog know some folders; at most one for each scale, month, variable and status. Lists nothing."""
        names = FOLDERS.fieldNames()
        specs = [
            f"PARTITION ({', '.join(f'{n} = {row[n]!r}' for n in names)})" for row in folders.select(*names).distinct().collect()
        ]
        for start in range(0, len(specs), 200):
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {' '.join(specs[start : start + 200])}")
        self.spark.sql(f"REFRESH TABLE {self.name}")

    def partitions(self) -> DataFrame:
        """The folders the catalog knows, with the status rank and where they are."""
        found = [row[0] for row in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        values = [[step.partition("=")[2] for step in path.split("/")] for path in found]
        rows = [
            (scale, int(year), int(month), variable, status, f"{self.root}/{path}")
            for path, (scale, year, month, variable, status) in zip(found, values)
        ]
        layout = T.StructType([*FOLDERS, T.StructField("location", T.StringType())])
        frame = self.spark.createDataFrame(rows, layout)
        name = file_name(*[F.col(c) for c in ("variable", "period_year", "period_month", "scale", "status")])
        return frame.withColumns({"status_rank": status_rank(F.col("status")), "file_name": name})

    def chosen(self, scale: str, wanted: Column | None = None) -> DataFrame:
        """The folders of the best status of each variable's month, of one scale and of what is wanted (a predicate on folder values)."""
        found = self.partitions().where(F.col("scale") == scale)
        return preferred(found if wanted is None else found.where(wanted))

    def scan(self, scale: str, wanted: Column | None = None) -> DataFrame:
        """Their rows. Other folders are pruned by partition filters and not listed."""
        found = self.partitions().where(F.col("scale") == scale)
        rows = self.spark.table(self.name).where((F.col("scale") == scale) & _not_superseded(found))
        return rows if wanted is None else rows.where(wanted)

    def close(self) -> None:
        """Take it out of the catalog. Files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def open_landing(spark: SparkSession, root: str, discover: bool = True) -> Landing:
    """Landed folders below root, entered in the catalog under a name made from root; listed once unless told not to."""
    root = root.rstrip("/")
    landing = Landing(spark, root, f"landed_{hashlib.sha1(root.encode()).hexdigest()[:16]}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*GRID_SCHEMA, *FOLDERS])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {landing.name} ({columns}) USING csv "
        f"PARTITIONED BY ({', '.join(FOLDERS.fieldNames())}) LOCATION '{root}'"
    )
    if discover:
        landing.discover()
    return landing


def partitions(spark: SparkSession, root: str) -> DataFrame:
    """The folder values that have files, with the status rank. Lists folders only."""
    return open_landing(spark, root).partitions().drop("location", "file_name")


def preferred(found: DataFrame) -> DataFrame:
    """Of each variable's month the best status present."""
    best = found.groupBy(*MONTH_OF_VARIABLE).agg(F.min("status_rank").alias("status_rank"))
    return found.join(best, [*MONTH_OF_VARIABLE, "status_rank"], "left_semi")


def wanted_folders(years: tuple[int, int] | None = None, variables: list[str] | None = None) -> Column:
    """A predicate on folder values."""
    wanted = F.lit(True)
    if years is not None:
        wanted = wanted & F.col("period_year").between(*years)
    if variables is not None:
        wanted = wanted & F.col("variable").isin(variables)
    return wanted


def scan(
    spark: SparkSession,
    root: str,
    scale: str,
    years: tuple[int, int] | None = None,
    variables: list[str] | None = None,
) -> DataFrame:
    """Grid rows of the best status of each month, with their folder values. Superseded folders, other years and
    variables are pruned by partition filters."""
    return open_landing(spark, root).scan(scale, wanted_folders(years, variables))


def with_folder_tags(files: DataFrame, path: str = "path") -> DataFrame:
    """Add what the folders in path say, under the names of the file tags; a path that isn't below such folders has no file name."""
    steps = {n: F.regexp_extract(path, f"/{n}=([^/]+)/", 1) for n in FOLDERS.fieldNames()}
    numbers = ("period_year", "period_month")
    tagged = files.withColumns({n: s.try_cast("int") if n in numbers else s for n, s in steps.items()})
    name = file_name(*[F.col(c) for c in ("variable", "period_year", "period_month", "scale", "status")])
    known = F.col("period_month").isNotNull() & (F.col("status") != "")
    return tagged.withColumns({"status_rank": status_rank(F.col("status")), "file_name": F.when(known, name).otherwise("")})


def _not_superseded(found: DataFrame) -> Column:
    """A predicate on folder values alone: not a status that a better one of the same month replaces."""
    kept = preferred(found)
    rest = found.join(kept, FOLDERS.fieldNames(), "left_anti")
    keep = F.lit(True)
    for status in [*STATUSES, None]:
        mine = F.col("status") == status if status else ~F.col("status").isin(*STATUSES)
        months = [row[0] for row in rest.where(mine).select(_month()).distinct().collect()]
        if months:
            keep = keep & ~(mine & _month().isin(months))
    return keep


def _month() -> Column:
    return F.format_string("%s-%04d%02d", "variable", "period_year", "period_month")
