"""A session with the settings that the folds rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Whether folds push the bounds of what they read into the scan. A test turns it off to see what it saves.
PUSH_SCAN_BOUND = "gridweave.pushScanBound"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("gridweave")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def pushes(spark: SparkSession) -> bool:
    return spark.conf.get(PUSH_SCAN_BOUND, "true").lower() == "true"
