"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC and Arrow; everything else is the cluster's."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
