"""Session settings shared by tests, the bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results rely on: instants are UTC everywhere.
SEMANTIC = {"spark.sql.session.timeZone": "UTC"}

#: Settings that only affect how a plan runs.
PHYSICAL = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-process session for tests and benches; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SEMANTIC, **PHYSICAL}.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
