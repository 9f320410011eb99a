"""A session with settings that suit stacks of rasters."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stackwave", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC dates and batches that fit a solver's working set; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
