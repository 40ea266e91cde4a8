"""Session settings the operators are designed around."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings only: they can be changed on a live session of any cluster.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join key holding a large share of the rows is split at run time, also where splitting costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Timestamps are compared and rendered in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app_name: str = "colweave", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # Expressions are built faster without a call site recorded for each of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and everything runs on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured or tempfile.mkdtemp(prefix="colweave-")
