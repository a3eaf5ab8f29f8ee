"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session for local runs. On a cluster, pass no master and let the submit
    command's settings stand: only settings with the same meaning everywhere are set."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = (
            b.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(partitions or 8))
        )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

