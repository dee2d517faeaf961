"""The Spark session with the settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "roadloom", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. Settings are given with underscores for dots; masters, memory and the shared
    spark.checkpoint.dir are the cluster's to name."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
