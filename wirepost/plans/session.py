"""The Spark session settings this package is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None,
          **extra: str) -> SparkSession:
    """On a cluster leave `master` and the partition count to the submit command."""
    b = (SparkSession.builder.appName("wirepost")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false") \
            .config("spark.driver.memory", "16g") \
            .config("spark.ui.showConsoleProgress", "false") \
            .config("spark.sql.autoBroadcastJoinThreshold", "1m") \
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
