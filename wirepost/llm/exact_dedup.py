"""Exact deduplication by composable polynomial fingerprints.

A text is equal to another when both are identical after every run of white space became one space.
The fingerprint of a normalised text is a polynomial over two 31-bit prime fields and its length.
Fingerprints form a monoid: H(ab) = H(a) * B**len(b) + H(b), so the chunks of a huge document are
hashed in parallel and combined.  Equal fingerprints never decide alone: the texts behind them are
compared chunk by chunk in a stream, and a fingerprint with unequal texts is split by SHA-256.

Defined results: null text counts as empty; empty texts are equal to each other; a null id is a row
like any other (`keep_id` is the smallest id that is not null, null if there is none); rows that
repeat an id count as rows of their own in `group_size`; an empty table gives an empty result; other
columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch
from wirepost.llm.words import BLANKS

CHUNK = 1 << 16
#: characters beyond which the chunks of a document are hashed by different tasks
HUGE = 1 << 23
_PRIMES = np.array([(1 << 31) - 1, (1 << 31) - 19], np.uint64)
_BASES = np.array([911382323, 972663749], np.uint64)
_KEY = ["fp1", "fp2", "length"]
_powers: list[np.ndarray] = []


def normal(text: bytes) -> bytes:
    """Every run of white space becomes one space."""
    body = b" ".join(text.split())
    if not text or not body:
        return b" " if text else b""
    return (b" " if text[0] in BLANKS else b"") + body + (b" " if text[-1] in BLANKS else b"")


def _table(k: int) -> np.ndarray:
    """B**(CHUNK-1) .. B**0 modulo prime k."""
    if not _powers:
        for p, b in zip(_PRIMES, _BASES):
            row = [1]
            for _ in range(CHUNK - 1):
                row.append(row[-1] * int(b) % int(p))
            _powers.append(np.array(row[::-1], np.uint64))
    return _powers[k]


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Both hashes of at most CHUNK bytes; the sums stay under 2**56."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(values, _table(k)[CHUNK - len(values):]) % _PRIMES[k]) for k in (0, 1))


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """H(ab) of H(a), H(b) and the length of b."""
    return tuple((left[k] * pow(int(_BASES[k]), right_length, int(_PRIMES[k])) + right[k]) % int(_PRIMES[k]) for k in (0, 1))


def fingerprint(text: bytes) -> tuple[int, int, int]:
    """Fingerprint of a normalised text, chunk by chunk."""
    total = (0, 0)
    for at in range(0, len(text), CHUNK):
        part = text[at:at + CHUNK]
        total = combine(total, chunk_hash(part), len(part))
    return (*total, len(text))


def _prints(huge: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2):
                raw = text.as_py()
                body = normal(raw)
                # the parts of a huge text are hashed elsewhere; its SHA-256 is a stream and stays here
                key = fingerprint(body) if len(raw) <= huge else (None, None, None)
                rows.append((*key, hashlib.sha256(body).hexdigest()))
            fp1, fp2, length, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(sha, pa.string())], ["id", "row", *_KEY, "text_sha256"])
    return run


def _part_prints(batches):
    """Fingerprint of each part without its outer blanks, and whether it has such blanks."""
    for batch in batches:
        rows = []
        for part in batch.column(2):
            raw = part.as_py()
            lead, trail = (raw[0] in BLANKS, raw[-1] in BLANKS) if raw else (False, False)
            rows.append((*fingerprint(b" ".join(raw.split())), lead, trail))
        fp1, fp2, length, lead, trail = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(length, pa.int64()),
             pa.array(lead, pa.bool_()), pa.array(trail, pa.bool_())], ["row", "part", *_KEY, "lead", "trail"])


def combine_parts(parts: list[dict]) -> tuple[int, int, int]:
    """Fingerprint of a document from those of its parts; blanks that meet become one."""
    space = chunk_hash(b" ")
    total, length, pending = (0, 0), 0, False
    for p in sorted(parts, key=lambda p: p["part"]):
        pending = pending or p["lead"]
        if p["length"]:
            if pending:
                total, length = combine(total, space, 1), length + 1
            total, length = combine(total, (p["fp1"], p["fp2"]), p["length"]), length + p["length"]
            pending = p["trail"]
    if pending:
        total, length = combine(total, space, 1), length + 1
    return (*total, length)


def _combined(batches):
    for batch in batches:
        rows = [combine_parts(parts) for parts in batch.column(1).to_pylist()]
        fp1, fp2, length = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(length, pa.int64())], ["row", *_KEY])


def parallel_fingerprints(texts: DataFrame, part_chars: int = CHUNK) -> DataFrame:
    """(row, fp1, fp2, length) of (row, text), the parts of each text spread over all tasks.  What
    meets in one task is three numbers a part."""
    count = F.greatest(F.ceil(F.length("text") / part_chars).cast("int"), F.lit(1))
    parts = (texts.select("row", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
             .select("row", "part", F.expr(f"cast(substring(text, part * {part_chars} + 1, {part_chars}) as binary)").alias("body"))
             .repartition("row", "part")
             .mapInArrow(_part_prints, "row bigint, part int, fp1 bigint, fp2 bigint, length bigint, lead boolean, trail boolean"))
    return (parts.dropDuplicates(["row", "part"]).groupBy("row")
            .agg(F.collect_list(F.struct("part", *_KEY, "lead", "trail")).alias("parts"))
            .mapInArrow(_combined, "row bigint, fp1 bigint, fp2 bigint, length bigint"))


def _chunks(batches):
    for batch in batches:
        for text in batch.column(0):
            body = normal(text.as_py())
            key = fingerprint(body)
            parts = [body[at:at + CHUNK] for at in range(0, len(body), CHUNK)]
            if parts:
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k] * n, pa.int64()) for k in key), pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())],
                    [*_KEY, "part", "body"])


def collisions(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints that unequal texts share, found by comparing the texts themselves: the distinct
    contents of each chunk position are counted, equal copies meet inside their task already."""
    multi = prints.groupBy(*_KEY).count().filter("count > 1").drop("count")
    asked = prints.join(multi, _KEY, "left_semi").select("id")
    texts = scratch.narrow(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", asked)
    chunks = texts.select(F.col("text").cast("binary").alias("text")) \
        .mapInArrow(_chunks, "fp1 bigint, fp2 bigint, length bigint, part bigint, body binary")
    return (chunks.join(multi, _KEY, "left_semi").distinct()
            .groupBy(*_KEY, "part").count().filter("count > 1").select(*_KEY).distinct())


def prints_of(docs: DataFrame, id_col: str, text_col: str, huge: int) -> DataFrame:
    """(id, row, fp1, fp2, length, text_sha256) of every row; `row` is a hash of its id and text."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .withColumn("row", F.xxhash64("id", "text"))
    prints = scratch.keep(base.select("id", "row", F.col("text").cast("binary").alias("text"))
                          .mapInArrow(_prints(huge), "id bigint, row bigint, fp1 bigint, fp2 bigint, length bigint, text_sha256 string"),
                          "prints")
    if prints.filter("fp1 is null").isEmpty():
        return prints
    far = scratch.keep(parallel_fingerprints(base.filter(F.octet_length("text") > huge).select("row", "text")), "parts")
    return prints.filter("fp1 is not null").unionByName(
        prints.filter("fp1 is null").drop(*_KEY).join(far, "row").select("id", "row", *_KEY, "text_sha256"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, huge: int) -> tuple[DataFrame, list[str]]:
    """Fingerprints of all rows, and the columns in which equal texts, and no others, agree."""
    prints = prints_of(docs, id_col, text_col, huge)
    clash = scratch.keep(collisions(docs, prints, id_col, text_col), "clash")
    if clash.isEmpty():
        return prints, list(_KEY)
    split = prints.join(clash.withColumn("clash", F.lit(True)), _KEY, "left") \
        .withColumn("split", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit(""))).drop("clash")
    return split, [*_KEY, "split"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`."""
    prints, key = _keyed(docs, id_col, text_col, huge)
    groups = prints.groupBy(*key).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return prints.join(groups, key).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the smallest id that is not
    null.  Rows are told apart by id and text, so different texts of one id all stay; of rows that
    repeat both, one stays, whichever it is."""
    prints, key = _keyed(docs, id_col, text_col, huge)
    named = F.struct("id", "row")
    kept = prints.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("id").isNotNull(), named)), F.min(named)).alias("k"))
    kept = scratch.keep(kept.select("k.row").distinct(), "kept")
    mine, theirs = scratch.fresh(docs, "row_hash", "kept_hash")
    hashed = docs.withColumn(mine, F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))))
    out = hashed.join(kept.withColumnRenamed("row", theirs), F.col(mine) == F.col(theirs), "left_semi")
    if not prints.groupBy("row").count().filter("count > 1").join(kept, "row", "left_semi").isEmpty():
        out = out.dropDuplicates([mine])
    return out.drop(mine)
