"""The Spark session that tests, the benchmark and examples use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine. On a cluster, use the session that the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("emberline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
