"""Session helpers: local defaults, lineage cutting, scalar lookups."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "shelfspan", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SHELFSPAN_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse,
    which executors reach as they reach managed tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Nothing reads the shuffle files behind it again, so they go at once, not when the driver
    happens to collect its garbage; a session's own setting comes back.
    """
    _checkpoint_dir_ready(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)


def scalar(one_row: DataFrame, column: str) -> Column:
    """The single value of a one-row aggregate, as a scalar subquery (no join)."""
    return one_row.select(column).scalar()
