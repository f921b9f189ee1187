"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sparkfolio", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; master and the number of shuffle partitions only where they are given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
