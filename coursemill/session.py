"""Session settings the jobs are written for. All of them are ordinary Spark options."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the size-dependent choices: broadcast below the threshold,
# sort-merge above it, splitting of hot join keys, merging of small shuffle partitions.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Files of the shop's tables are a tenth or less of their rows in memory. Spark takes the files' size for the rows'
# when it picks what to broadcast, by way of the driver; this tells it otherwise.
COMPRESSED = {"spark.sql.sources.fileCompressionFactor": "16"}
SETTINGS = {
    **ADAPTIVE,
    **COMPRESSED,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def apply_settings(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "coursemill", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
