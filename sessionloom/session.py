"""A session with the settings that the refinery assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "sessionloom", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling; ``conf`` has dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
