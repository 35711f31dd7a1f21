"""Intermediate tables and bounded filters shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bits of `narrow`'s bitmap: 2**26 bits are at most 2**20 rows of one 64-bit word each
FILTER_BITS = 1 << 26


def folder(spark: SparkSession) -> str:
    """The shared folder the session names in `spark.checkpoint.dir`.  Only where none is set, as
    in tests, one of its own is chosen and set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = tempfile.mkdtemp(prefix="wirepost-llm-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there, and lost
    executors cost nothing but the tasks they ran."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, changed where `df` has columns of that name already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`df` with __maybe, false where `key` does not occur in the first column of `wanted`.

    A bitmap over hashed keys, at most 2**20 rows however large `wanted` is, goes to every task.
    False positives remain; a full bitmap only stops helping."""
    name = wanted.columns[0]
    bits = (wanted.select(_slot(F.col(name)).alias("slot")).distinct()
            .groupBy(F.shiftright("slot", 6).alias("__word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("__bits")))
    return (df.withColumns({"__at": _slot(F.col(key))})
            .join(F.broadcast(bits), F.shiftright("__at", 6) == F.col("__word"), "left")
            .withColumn("__maybe", F.expr("coalesce((shiftright(__bits, cast(__at & 63 as int)) & 1L) = 1L, false)"))
            .drop("__at", "__word", "__bits"))


def narrow(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose `key` may occur in the first column of `wanted`: no wanted row is lost, and
    rows nobody asks for (texts, mostly) need no shuffle.  An exact join follows."""
    return _marked(df, key, wanted).filter("__maybe").drop("__maybe")


def split(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be wanted, rows that are certainly not)."""
    marked = _marked(df, key, wanted)
    return marked.filter("__maybe").drop("__maybe"), marked.filter("not __maybe").drop("__maybe")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_wirepost_llm", False):
        return
    root = Path(__file__).resolve().parents[2]
    kept = f"{SparkFiles.getRootDirectory()}/wirepost_llm_source.zip"
    with zipfile.ZipFile(kept, "w") as z:
        for own in [root / "wirepost/__init__.py", *sorted((root / "wirepost/llm").glob("*.py"))]:
            z.write(own, own.relative_to(root))
    sc.addPyFile(kept)
    sc._wirepost_llm = True
