"""Session defaults. On a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        build = build.config(k, v)
    return build.getOrCreate()
