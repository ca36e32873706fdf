"""Session defaults every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tarnbeck", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one in UTC with adaptive execution.

    Settings of an existing session are never overwritten: on a cluster they
    belong to whoever submitted the job.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
