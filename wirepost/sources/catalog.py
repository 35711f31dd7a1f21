"""The run catalogue as tables: assessments, runs, run_events, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirepost.functions import vocab

RUNTIME_FIELDS = ("run_id", "generated_at")
PAGE = 20


def canonical(col: Column, kind: T.DataType) -> Column:
    """The same value with the keys of every level in order; a map becomes its entries, by key."""
    if isinstance(kind, T.StructType):
        fields = [canonical(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda v: canonical(v, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(col), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
    return col


def canonical_json(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row as JSON text: keys of every level in order, missing values written out, so that equal
    contents share one text and no two contents do."""
    fields = sorted((f for f in df.schema.fields if f.name not in without), key=lambda f: f.name)
    document = F.struct(*[canonical(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return F.to_json(document, {"ignoreNullFields": "false"})


def content_hash(df: DataFrame) -> Column:
    """Hash of a row's canonical JSON without its runtime fields."""
    return F.sha2(canonical_json(df, RUNTIME_FIELDS), 256)


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and content of a table per key, whatever its order: the hashes of the rows are added as
    eight integers of 32 bits, so no key is collected or sorted.  Rows whose hashes begin alike are added
    in 64 bits, which hold two billion of them; only these few sums are added as decimals."""
    hashed = df.select(*keys, F.sha2(canonical_json(df, tuple(keys)), 256).alias("_h"))
    own = [f"_p{i}" for i in range(8)]
    begun = hashed.groupBy(*keys, F.substring("_h", 1, 2).alias("_begin")).agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(p) for i, p in enumerate(own)])
    n = F.sum("_n")
    parts = [F.sum(F.col(p).cast("decimal(38,0)")).cast("string") for p in own]
    return begun.groupBy(*keys).agg(n.alias("rows"), F.sha2(F.concat_ws("|", n.cast("string"), *parts), 256).alias("digest"))


def upsert_assessments(new: DataFrame, stored: DataFrame) -> DataFrame:
    """What storing each new assessment means: insert, replay of equal content, or conflict.  Two
    contents for one new id are a conflict, too: neither is older."""
    old = stored.select("assessment_id", F.col("content_sha256").alias("_old"))
    own = new.groupBy("assessment_id").agg((F.min("content_sha256") != F.max("content_sha256")).alias("_several"))
    return new.join(own, "assessment_id").join(old, "assessment_id", "left").withColumn(
        "action", F.when(F.col("_old") == F.col("content_sha256"), "replay")
        .when(F.col("_old").isNotNull() | F.col("_several"), "conflict").otherwise("insert")).drop("_old", "_several")


def page_size(requested: int) -> int:
    return PAGE if requested <= 0 else requested


def list_runs(runs: DataFrame, assessments: DataFrame, state: str | None = None,
              capture_id: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page of runs, newest first, with their assessment and the filtered total."""
    kept = runs
    if state:
        kept = kept.filter(F.col("state") == state)
    if capture_id:
        kept = kept.filter(F.col("capture_id") == capture_id)
    total = kept.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_one"))
    page = kept.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).offset(offset).limit(page_size(limit))
    slim = assessments.select("assessment_id", "overall_posture", "score_value")
    return page.withColumn("_one", F.lit(1)).join(slim, "assessment_id", "left") \
        .join(F.broadcast(total), "_one").drop("_one")


def first_completed_run(runs: DataFrame) -> DataFrame:
    """Earliest completed run with an assessment per (capture, ai, formula), null formula included."""
    done = runs.filter((F.col("state") == "COMPLETED") & F.col("assessment_id").isNotNull())
    return done.groupBy("capture_id", "ai_enabled", "formula_id").agg(
        F.min_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.min("created_at").alias("created_at"))


def audit_transitions(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Each logged transition: was the edge allowed, and does the trail connect?"""
    w = W.partitionBy("run_id").orderBy("event_id")
    edges = F.broadcast(vocab.dim_edges(spark).withColumn("_ok", F.lit(True)))
    trail = events.withColumn("_last", F.lag("to_state").over(w))
    return trail.join(edges, ["from_state", "to_state"], "left").withColumns({
        "allowed": F.coalesce("_ok", F.lit(False)) | F.col("from_state").isNull(),
        "contiguous": F.col("from_state").eqNullSafe(F.col("_last"))}).drop("_ok", "_last")


def interrupted_runs(events: DataFrame) -> DataFrame:
    """Runs whose latest state is not final."""
    latest = events.groupBy("run_id").agg(F.max_by("to_state", "event_id").alias("state"))
    return latest.filter(F.col("state").isin(vocab.INTERRUPTIBLE))


def sweep_events(interrupted: DataFrame) -> DataFrame:
    """The two log rows that close an interrupted run."""
    step = lambda a, b, n: F.struct(F.lit(n).alias("step"), a.alias("from_state"), b.alias("to_state"))
    mid = F.lit("RECOVERY_REQUIRED")
    return interrupted.select("run_id", F.inline(F.array(step(F.col("state"), mid, 1), step(mid, F.lit("FAILED"), 2))))


def verify_artifacts(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded against actual content hash; a path without a file is missing."""
    actual = files.select("path", F.col("sha256").alias("_actual"))
    return catalog.join(actual, "path", "left").withColumn(
        "integrity", F.when(F.col("_actual").isNull(), "MISSING")
        .when(F.col("_actual") == F.col("sha256"), "OK").otherwise("MISMATCH")).drop("_actual")


def usable_artifact(verified: DataFrame) -> DataFrame:
    """Newest current and intact artifact per run and kind."""
    good = verified.filter((F.col("integrity") == "OK") & F.col("current"))
    return good.groupBy("run_id", "kind").agg(F.max_by("artifact_id", F.struct("created_at", "artifact_id")).alias("artifact_id"))


def store_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def write_assessments(assessments: DataFrame, path: str) -> None:
    """One JSON document per assessment, partitioned by band."""
    doc = F.to_json(F.struct(*[F.col(c) for c in assessments.columns]))
    assessments.select("band", doc.alias("value")).write.mode("overwrite").partitionBy("band").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """The nested documents as canonical JSON lines, partitioned by band."""
    documents.select(F.col("overall_posture").alias("band"), canonical_json(documents).alias("value")) \
        .write.mode("overwrite").partitionBy("band").text(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents as they were written; a line that is no such document fails the read."""
    lines = spark.read.schema("value string, band string").text(path)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
