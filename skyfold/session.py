"""A session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that time-zone-less and UTC instants agree; files without a UTC flag load as instants; adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(name: str = "skyfold", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()
