"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "zonecast", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as keywords with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
