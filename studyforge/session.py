"""Spark session with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "studyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings already present win."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
