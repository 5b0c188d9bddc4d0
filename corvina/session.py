"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corvina", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings stay as they are."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
