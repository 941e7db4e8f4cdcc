"""SparkSession factory with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracelake", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow on; ``conf`` (dots as __) overrides."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
