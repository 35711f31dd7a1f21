"""Cutting lineage where one intermediate feeds many branches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.  One of its own is chosen only
    where none is configured, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="wirepost-checkpoint-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table below the shared folder, computed once.  A checkpoint runs its last stage twice,
    once to count and once to write, and keeps rows as they lie in memory; a table runs it once and packs
    repeated values."""
    return Stages(df.sparkSession, "cut").table("rows", df)


def is_few(rows: DataFrame, most: int = 2000) -> bool:
    """Whether a table that is already written has no more than `most` rows."""
    return rows.limit(most + 1).count() <= most


def hinted(few: DataFrame, most: int = 2000) -> DataFrame:
    """A table that is already written, marked for a copy per executor if it has no more than `most` rows.
    Only its rows are counted; with more of them the plan is left to Spark."""
    return F.broadcast(few) if is_few(few, most) else few


class Stages:
    """Tables of one run below the shared folder, each written once and read by whatever follows."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark, self.path = spark, scratch(spark, name)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
