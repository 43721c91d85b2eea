"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "8g", **more: str) -> SparkSession:
    """On a cluster pass its master and some two to three shuffle partitions per core."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": driver_memory,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false",
    } | more
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
