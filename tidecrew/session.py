"""Session settings the operators count on.

All of them are runtime SQL settings, so :func:`tune` can be applied to a session that a cluster or a notebook
already made.  Settings that somebody set on purpose are left alone, but for the time zone.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many-to-one lookups keep the fact table on the left, so a hot key is split at run time, also when an
    # aggregate behind the join then needs a shuffle of its own.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Per-group top-k is cut to k rows per task before the shuffle (all our k are below this).
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Streaming state lives on disk and off the heap, so it may outgrow the executor's memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# The tables' timestamps carry no zone.  Day windows and ages in days need one, and it has to be the same everywhere.
ZONE = ("spark.sql.session.timeZone", "UTC")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that are not already set in the session's own configuration, and the time zone."""
    own = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    spark.conf.set(*ZONE)
    return spark


def local_session(cores: int | str = 8, app: str = "tidecrew") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A single machine shares its own folders; a cluster names one that all its machines reach.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
