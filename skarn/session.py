"""A Spark session with the settings the operators assume; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "skarn", cores: int | None = None, **conf: str) -> SparkSession:
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
