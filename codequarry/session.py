"""Spark sessions with the settings that results depend on (UTC) and those that scale asks for (adaptive plans)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "codequarry", **conf: str) -> SparkSession:
    """A session; `master` is left to spark-submit when it is not given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
