"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import datetime
import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def build_session(app: str = "terrapanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; extra settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # otherwise every column expression records where it was written, most of the time that building a long one takes
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may fall back to a temporary one: tools that bring a plain
    local session set none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"terrapanel-{spark.sparkContext.applicationId}")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder no earlier run has used."""
    return f"{shared_root(spark)}/terrapanel/{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back. Runs a job.

    The lineage above is cut, so the work is done once and a lost executor only
    costs a re-read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    log.info("%s staged in %s", label, path)
    return spark.read.schema(df.schema).parquet(path)


_landed: dict[tuple[str, ...], str] = {}


def landed_once(spark: SparkSession, label: str, source: str, write: Callable[[str], None]) -> str:
    """Path of a table written once per session from a source. Runs a job the first time."""
    key = (spark.sparkContext.applicationId, label, source)
    if key not in _landed:
        path = fresh_path(spark, label)
        write(path)
        _landed[key] = path
    return _landed[key]


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _hadoop(spark: SparkSession, path: str):
    """The path as the cluster's file system sees it, and that file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below path, none if there is no such path. One listing of one level."""
    system, at = _hadoop(spark, path)
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory())


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    system, at = _hadoop(spark, path)
    system.create(at, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _hadoop(spark, path)
    return system.exists(at)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove folders that nothing reads any more: replaced versions, staged data of a finished load."""
    for path in paths:
        system, at = _hadoop(spark, path)
        system.delete(at, True)


def version_name() -> str:
    """A folder name that sorts behind those made before."""
    return f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
