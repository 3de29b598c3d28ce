import os
import sys

import pytest
from pyspark import SparkContext
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from terrapanel.session import build_session  # noqa: E402


def _alive(session):
    try:
        return session is not None and not session.sparkContext._jsc.sc().isStopped() and session.range(1).count() == 1
    except Exception:  # whatever a dead JVM or context raises
        return False


def _forget_dead_gateway():
    """After the loss of the JVM, the next session starts another."""
    try:
        SparkContext._jvm.java.lang.System.nanoTime()
    except Exception:
        SparkContext._gateway = SparkContext._jvm = SparkContext._active_spark_context = None
        SparkSession._instantiatedSession = None


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    """One session for all modules, and another one if it has died in an earlier module."""
    session = SparkSession.getActiveSession()
    if not _alive(session):
        if session is not None:
            try:
                session.stop()
            except Exception:
                pass
            _forget_dead_gateway()
        session = build_session(
            "tests",
            "local[8]",
            **{
                "spark.sql.shuffle.partitions": "8",
                # listing many folders as one task each costs more here than the listing itself
                "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
                "spark.driver.memory": "6g",
                "spark.sql.maxMetadataStringLength": "2000",
                "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
                "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            },
        )
        session.sparkContext.setLogLevel("ERROR")
    yield session
    if not _alive(session):
        return
    session.catalog.clearCache()
