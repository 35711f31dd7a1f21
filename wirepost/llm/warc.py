"""Content-addressed WARC archive.

An archive is two tables.  `headers` holds the exact header block of each record and the SHA-256 of
its payload; `payloads` holds the bytes behind each digest once, as a zstandard frame.  Joining them
gives the original records back, byte by byte.  The digest is verified twice: when writing, rows of
one SHA-256 must agree in length and SHA-1; when reading, the bytes must hash to their name.

Of records with equal payloads of at least `smallest` bytes that with the largest id is the
response, the others are revisits that refer to it; all shorter ones are responses.

Defined results: a null payload counts as empty; a null url is an empty target URI; a null id is
written as `none`, comes back null and is the response only where no other record has its payload;
records that repeat an id are records of their own; an empty table gives an empty archive; other
columns are not read."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepost.llm import scratch

SMALLEST = 0
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
_END = "\r\n"
_ID = "urn:x-page:"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: Column) -> Column:
    """Header block of a record; the columns are those of `records_of`."""
    name = F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    refers = F.when(F.col("record_type") == "revisit", F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _END + f"WARC-Refers-To: <{_ID}"),
        F.coalesce(F.col("refers_to").cast("string"), F.lit("none")), F.lit(">" + _END))).otherwise(F.lit(""))
    return F.concat(F.lit("WARC/1.1" + _END + "WARC-Type: "), kind, F.lit(_END + "WARC-Record-ID: "), name,
                    F.lit(_END + f"WARC-Date: {DATE}" + _END + "WARC-Target-URI: "),
                    F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " "), F.lit(_END), refers,
                    F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
                    F.lit(_END + "Content-Type: text/html" + _END + "Content-Length: "), F.col("payload_bytes").cast("string"),
                    F.lit(_END + _END))


def _payload(col: str) -> Column:
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def records_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str, smallest: int) -> DataFrame:
    """(page_id, url, sha256, payload_bytes, payload_digest, record_type, refers_to, keeper)."""
    body = _payload(payload_col)
    heads = scratch.keep(pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.unhex(F.sha2(body, 256)).alias("sha256"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"), base32(F.sha1(body)).alias("payload_digest")), "heads")
    agree = (F.min("payload_bytes") == F.max("payload_bytes")) & (F.min("payload_digest") == F.max("payload_digest"))
    named = heads.groupBy("sha256").agg(F.max("page_id").alias("keeper"), agree.alias("agree")) \
        .withColumn("keeper", F.when(F.col("agree"), F.col("keeper")).otherwise(F.raise_error("two payloads share a SHA-256").cast("bigint")))
    own = F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(own | (F.col("payload_bytes") < smallest), "response").otherwise("revisit")
    return heads.join(named, "sha256").withColumn("record_type", kind) \
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("keeper"))).drop("agree")


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        frames = pa.array([packer.compress(p.as_py()) for p in batch.column(1)], pa.binary())
        digests = pa.array([hashlib.sha256(p.as_py()).digest() for p in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, frames], ["id", "digest", "frame"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  smallest: int = SMALLEST) -> None:
    """Write the tables `headers` and `payloads` below `path`."""
    records = records_of(pages, id_col, url_col, payload_col, smallest)
    records.select("sha256", _header(F.col("record_type")).cast("binary").alias("header")).write.parquet(f"{path}/headers")
    headers_of = records.groupBy("sha256", "keeper").count().select("sha256", "keeper")
    packed = pages.select(F.col(id_col).alias("id"), _payload(payload_col).alias("payload")) \
        .mapInArrow(_pack, "id bigint, digest binary, frame binary")
    once = packed.join(headers_of, (F.col("digest") == F.col("sha256")) & F.col("id").eqNullSafe(F.col("keeper")), "left_semi")
    repeated = records.filter(F.col("page_id").eqNullSafe(F.col("keeper"))).groupBy("sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        once = once.dropDuplicates(["digest"])
    once.select(F.col("digest").alias("sha256"), "frame").write.option("compression", "none").parquet(f"{path}/payloads")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(_END)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:]))
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length and Content-Length differ")
    return fields, rest[:size]


def _rebuild(batches):
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for digest, header, frame in zip(*(c.to_pylist() for c in batch.columns)):
            payload = unpacker.decompress(frame)
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"stored payload does not match {digest.hex()}")
            out.append(header + payload + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record): the original records, rebuilt by joining headers with payloads.  A header without
    its payload is an error, not a missing row."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "sha256", "left")
    whole = F.when(F.col("frame").isNotNull(), F.col("frame")).otherwise(F.raise_error("payload is missing").cast("binary"))
    return joined.select("sha256", "header", whole.alias("frame")).mapInArrow(_rebuild, "record binary")


def _number(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(_ID)
    return None if value == "none" else int(value)


def _facts(batches):
    for batch in batches:
        rows = []
        for record in batch.column(0):
            fields, payload = parse(record.as_py())
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
            refers = fields.get("warc-refers-to")
            rows.append((_number(fields["warc-record-id"]), len(payload), digest, fields["warc-type"], _number(refers) if refers else None))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                         ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def facts(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from whole records."""
    return records.select("record").mapInArrow(
        _facts, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
