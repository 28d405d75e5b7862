"""Session factory and the few settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def make_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "velarium", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; `conf` adds or overrides settings."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
