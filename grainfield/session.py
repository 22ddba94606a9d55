"""A session with the settings that the engine is designed for."""

from pyspark.sql import SparkSession


def session(name: str = "grainfield", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, and Arrow; the number of shuffle partitions is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
