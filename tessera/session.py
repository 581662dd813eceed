"""The session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(name: str = "tessera", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with CONF under whatever the caller sets."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | (conf or {})).getOrCreate()
