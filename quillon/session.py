"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "quillon", **settings: str) -> SparkSession:
    """Adaptive execution, Arrow and UTC; settings override, with __ for dots."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    conf |= {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
