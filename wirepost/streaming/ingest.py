"""Arriving packet files and arriving assessments."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirepost.sources import catalog, ek


def stream_frames(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Typed frames of packet files as they arrive; the projection is stateless, so no state and
    no watermark is needed.  Sessions are built later, from captures that are complete."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return ek.frames_from(ek.parse_ek(lines.withColumn("capture_id", ek.capture_name(F.col("_metadata.file_path")))))


class AssessmentStore:
    """Stored assessments and conflicts, committed together a batch at a time.

    A batch writes both tables into folders of its own attempt; one row of the manifest then names the
    attempt, and only attempts it names are read.  A batch that fails before its row is as if it never
    ran and starts anew when repeated; a batch that has its row is not run again.  Two attempts that
    both reach the manifest count once.  `stream` tells the batch numbers of several queries apart.
    """
    MANIFEST = "stream string, epoch bigint, attempt string"

    def __init__(self, path: str, stream: str = "assessments"):
        self.path, self.stream = path.rstrip("/"), stream

    def _rows(self, spark: SparkSession, part: str, schema: T.StructType) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """The attempt that counts for each batch."""
        rows = self._rows(spark, "manifest", T.StructType.fromDDL(self.MANIFEST))
        return rows.groupBy("stream", "epoch").agg(F.min("attempt").alias("attempt"))

    def read(self, spark: SparkSession, part: str, schema: T.StructType) -> DataFrame:
        """`stored` or `conflicts`, of committed batches only."""
        fields = [f for f in schema.fields if f.name != "attempt"]
        rows = self._rows(spark, part, T.StructType([*fields, T.StructField("attempt", T.StringType())]))
        return rows.join(self.manifest(spark), "attempt", "left_semi").drop("attempt")

    def commit(self, spark: SparkSession, epoch: int, attempt: str) -> None:
        row = spark.range(0, 1, 1, 1).select(F.lit(self.stream).alias("stream"), F.lit(epoch).cast("bigint").alias("epoch"),
                                             F.lit(attempt).alias("attempt"))
        row.write.mode("append").parquet(f"{self.path}/manifest")

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """`foreachBatch` sink: new ids are stored, equal content is a replay, and differing content
        under a stored id, or under one new id of the batch, goes to the conflicts."""
        spark = batch.sparkSession
        if not self.manifest(spark).filter((F.col("stream") == self.stream) & (F.col("epoch") == epoch)).isEmpty():
            return
        attempt = f"b{epoch}-{uuid.uuid4().hex}"
        asked = self.read(spark, "stored", batch.schema).join(batch.select("assessment_id").distinct(), "assessment_id", "left_semi")
        decided = catalog.upsert_assessments(batch.dropDuplicates(["assessment_id", "content_sha256"]), asked).persist()
        for part, action in (("conflicts", "conflict"), ("stored", "insert")):
            decided.filter(F.col("action") == action).select(*batch.columns).write.parquet(f"{self.path}/{part}/attempt={attempt}")
        self.commit(spark, epoch, attempt)
        decided.unpersist()
