"""A session with the settings that the library's queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC as session time zone, adaptive execution on. Master and shuffle partitions are set only if given: on a cluster spark-submit has them."""
    b = SparkSession.builder.appName("brindle")
    if master is not None:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
