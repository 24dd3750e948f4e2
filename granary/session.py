"""Session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "granary", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` with dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
