"""Session settings the library is developed against.

Nothing in the library changes a session it is handed; this builder is for tests, the bench
and interactive use.  A cluster job passes its own session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidemark"
) -> SparkSession:
    """A session with AQE on, UTC timestamps and Arrow transfer."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
