"""Session helper for tests, benchmarks and notebooks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE on).

    On a cluster the session comes from spark-submit; nothing in the library needs this function.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftgraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
