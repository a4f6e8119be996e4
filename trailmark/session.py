"""Spark session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings needed for right results: all calendar arithmetic is UTC, and a
# JSON body with a repeated key keeps its last value instead of failing to parse.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Plans here have many columns; noting the Python line of every expression for error
# messages takes longer than planning them. A static setting: only for new sessions.
PLANNING_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in {**RESULT_SETTINGS, **PLANNING_SETTINGS}.items():
        builder = builder.config(key, value)
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables.

    It lies under the shared folder of `spark.checkpoint.dir`, so executors on any
    node can read it back after a loss. Only a local master may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        run = spark.sparkContext.applicationId
        stamp = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
        return f"{base.rstrip('/')}/trailmark/{run}/{name}-{stamp}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(tempfile.mkdtemp(prefix="trailmark-"), name)
