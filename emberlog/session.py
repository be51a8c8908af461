"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from emberlog.errors import QueryError


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise QueryError("INVALID_INPUT", "spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="emberlog-")
