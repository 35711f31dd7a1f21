"""Dissected packets: newline-delimited JSON in, one typed row per frame out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.operators import skew

FLAT = "map<string,string>"
FRAME_BLOCK = 65_536


def parse_ek(lines: DataFrame, text: str = "value") -> DataFrame:
    """Keep the lines that are JSON objects with `layers`; index, blank and broken lines go."""
    record = F.from_json(F.col(text), f"layers {FLAT}", {"mode": "PERMISSIVE"})
    return lines.withColumn("layers", record["layers"]).filter(F.col("layers").isNotNull()) \
        .drop(text)


def capture_name(path: Column) -> Column:
    """A capture's id: its file's name, and a digest of the whole path, since folders may hold files
    of one name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(name, F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def read_ek(spark: SparkSession, path: str) -> DataFrame:
    """Packet records under `path` and its folders; every file is one capture."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_ek(lines.withColumn("capture_id", capture_name(F.col("_metadata.file_path"))))


def flatten_layers(records: DataFrame) -> DataFrame:
    """One flat name -> text map per packet.  A later layer wins over an earlier one, and a
    field standing directly under `layers` wins over both.  Layers seldom share a name; where none
    do, their fields are strung together, and only other packets are merged layer by layer."""
    def nested(v):
        return F.coalesce(v.startswith("{"), F.lit(False))

    def merge(into: Column, more: Column) -> Column:
        kept = F.map_filter(into, lambda k, v: ~F.map_contains_key(more, k))
        return F.map_concat(kept, more)

    none = F.create_map().cast(FLAT)
    inner = F.transform(F.filter(F.map_values("layers"), nested), lambda text: F.coalesce(F.from_json(text, FLAT), none))
    direct = F.map_filter("layers", lambda k, v: ~nested(v))
    read = records.withColumn("_layers", F.concat(inner, F.array(direct)))
    strung = read.withColumn("_names", F.flatten(F.transform("_layers", lambda m: F.map_keys(m))))
    apart = F.size(F.array_distinct("_names")) == F.size("_names")
    texts = F.flatten(F.transform("_layers", lambda m: F.map_values(m)))
    flat = F.when(apart, F.map_from_arrays("_names", texts)).otherwise(F.aggregate("_layers", none, merge))
    return strung.withColumn("flat", flat).drop("layers", "_layers", "_names")


def _pick(name: str) -> Column:
    return casts.pick("flat", vocab.FIELD_NAMES[name])


def _pick_all(name: str) -> Column:
    return casts.pick_all("flat", vocab.FIELD_NAMES[name])


def app_protocol(stack: str = "protocol_stack") -> Column:
    """Last mail token of the protocol stack."""
    known = F.filter(F.col(stack), lambda t: t.isin(list(vocab.PROTOCOL_TOKENS)))
    return casts.lookup(vocab.PROTOCOL_TOKENS, F.get(known, F.size(known) - 1),
                        F.lit(None).cast("string"))


def implicit_port(dst: str = "dst_port", src: str = "src_port") -> Column:
    ports = [p for p, (_, implicit) in vocab.MAIL_PORTS.items() if implicit]
    return casts.int_set(F.col(dst), ports) | casts.int_set(F.col(src), ports)


def keep_payload() -> Column:
    """Payload is kept for mail dialogue, and on mail ports while the frame is not TLS."""
    ports = list(vocab.MAIL_PORTS)
    on_port = casts.int_set(F.col("src_port"), ports) | casts.int_set(F.col("dst_port"), ports)
    encrypted = F.arrays_overlap("protocol_stack", F.array(F.lit("tls"), F.lit("ssl")))
    return F.col("app_protocol").isNotNull() | (on_port & ~encrypted)


def stream_key(capture: str = "capture_id", stream: str = "tcp_stream_id") -> Column:
    return F.when(F.col(stream).isNotNull(),
                  F.concat_ws(":", F.col(capture), F.col(stream).cast("string")))


def missing_fields() -> Column:
    return F.array_compact(F.array(
        F.when(_pick("frame_number").isNull(), "frame_number"),
        F.when(_pick("tcp_stream").isNull(), "tcp_stream"),
        F.when(_pick("time_epoch").isNull(), "timestamp")))


def _x509() -> Column:
    """Name -> values, only when a serial number anchors a certificate."""
    entries = [F.struct(F.lit(name).alias("k"), casts.pick_all("flat", alternatives).alias("v"))
               for name, alternatives in vocab.X509_FIELD_NAMES.items()]
    present = F.filter(F.array(*entries), lambda e: F.size(e["v"]) > 0)
    has_serial = F.size(casts.pick_all("flat", vocab.X509_FIELD_NAMES["serials"])) > 0
    return F.when(has_serial, F.map_from_entries(present))


def project_frames(flat: DataFrame) -> DataFrame:
    """Typed frame rows from flattened packet records."""
    has = lambda prefix: F.exists(F.map_keys("flat"), lambda k: k.startswith(prefix))
    stack = _pick("protocols")
    base = flat.select(
        "capture_id", "flat",
        casts.to_int(_pick("frame_number")).alias("frame_number"),
        casts.to_int(_pick("tcp_stream")).alias("tcp_stream_id"),
        casts.to_epoch(_pick("time_epoch")).alias("timestamp_epoch"),
        _pick("src_ip").alias("src_ip"), _pick("dst_ip").alias("dst_ip"),
        casts.to_int(_pick("src_port")).cast("int").alias("src_port"),
        casts.to_int(_pick("dst_port")).cast("int").alias("dst_port"),
        F.when(has("tcp_"), "tcp").when(has("udp_"), "udp").alias("transport"),
        casts.to_int(_pick("frame_len")).alias("frame_length"),
        casts.to_int(_pick("tcp_seq")).alias("tcp_seq"),
        _pick("tcp_flags").alias("tcp_flags"),
        _pick("tcp_payload").alias("payload_hex"),
        F.when(F.coalesce(stack, F.lit("")) == "", F.array().cast("array<string>"))
         .otherwise(F.split(stack, ":")).alias("protocol_stack"),
        missing_fields().alias("missing"))
    typed = base.withColumn("app_protocol", app_protocol())
    hs_type = casts.to_int(_pick("tls_handshake_type"))
    app_data = _pick("tls_app_data").isNotNull()
    record, suite, sni = (_pick(n) for n in ("tls_record_version", "tls_ciphersuite", "tls_sni"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return typed.select(
        "capture_id", "frame_number", "tcp_stream_id", "timestamp_epoch", "src_ip", "dst_ip",
        "src_port", "dst_port", "transport", "frame_length", "tcp_seq", "tcp_flags",
        F.col("payload_hex").isNotNull().alias("has_payload"),
        "protocol_stack", "app_protocol", implicit_port().alias("implicit_tls_port"),
        F.struct(
            record.alias("record_version"), hs_type.cast("int").alias("handshake_type"),
            _pick("tls_handshake_version").alias("handshake_version"),
            suite.alias("cipher_suite"), sni.alias("sni"),
            _pick("tls_supported_version").alias("supported_version"),
            _pick("tls_session_id").alias("session_id"), app_data.alias("has_app_data"),
            _pick("tls_key_share_group").alias("key_share_group"), _x509().alias("x509"),
            (filled(record) | hs_type.isNotNull() | filled(suite) | filled(sni) | app_data)
            .alias("present")).alias("tls"),
        F.struct(
            _pick("smtp_command").alias("smtp_command"),
            _pick("smtp_command_line").alias("smtp_command_line"),
            _pick("smtp_response_code").alias("smtp_response_code"),
            _pick_all("smtp_response_params").alias("smtp_response_params"),
            _pick("imap_command").alias("imap_command"),
            _pick("imap_response_status").alias("imap_response_status"),
            _pick_all("imap_lines").alias("imap_lines"),
            _pick("pop_command").alias("pop_command"),
            _pick("pop_response_indicator").alias("pop_response_indicator"),
            _pick("pop_response_description").alias("pop_response_description")).alias("mail"),
        F.when(keep_payload(), casts.decode_payload(F.col("payload_hex"))).alias("payload_text"),
        "missing", stream_key().alias("stream_key"))


def frames_from(records: DataFrame) -> DataFrame:
    return project_frames(flatten_layers(records))


# --------------------------------------------------------------------------- whole captures
def flag_ceiling(frames: DataFrame, limit: int = vocab.MAX_FRAMES) -> DataFrame:
    """Every frame, with whether its capture has more than `limit`."""
    over = frames.groupBy("capture_id").agg((F.count(F.lit(1)) > limit).alias("limit_exceeded"))
    return frames.join(over, "capture_id")


def cap_frames(frames: DataFrame, limit: int) -> DataFrame:
    """For a caller who asks for it: the first `limit` frames of each capture, flagged."""
    blocked = frames.withColumn("_block", F.floor(F.coalesce("frame_number", F.lit(0))
                                                  / FRAME_BLOCK))
    ranked = skew.ordinals(blocked, ["capture_id"], "_block", ["frame_number"], "_n")
    return flag_ceiling(ranked, limit).filter(F.col("_n") <= limit).drop("_n", "_block")


#: files up to this size are hashed by Spark's own function, as one value of a row
WHOLE_FILE = 64 << 20
PIECE = 1 << 20


def _open_stream(path: str):
    """A file of a path as Spark names it, read as bytes whatever its suffix says."""
    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store.open_input_stream(at, compression=None)


def _stream_digests(batches: Iterator) -> Iterator:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _open_stream(path) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def capture_catalog(spark: SparkSession, glob: str, whole: int = WHOLE_FILE) -> DataFrame:
    """Content identity of every capture file, of any size.

    A file above `whole` bytes never becomes a value of a row: only its path travels, and the task that
    gets it reads the file in pieces of 1 MiB.  The content of the others is read by Spark; neither
    branch opens the files of the other.  The number of tasks is given, as paths are too small for
    adaptive execution to keep them apart.  Spark plans no read of an empty file, so those are the
    names of its own listing that no read returns."""
    files = spark.read.format("binaryFile").load(glob)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select("path", "length").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path") \
        .mapInPandas(_stream_digests, "path string, length bigint, sha256 string")
    one_slash = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    listed = spark.createDataFrame([(unquote(path),) for path in files.inputFiles()], "path string").withColumn("path", one_slash("path"))
    empty = listed.join(files.select(one_slash("path").alias("path")), "path", "left_anti") \
        .select("path", F.lit(0).cast("bigint").alias("length"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return small.unionByName(large).unionByName(empty).select(
        F.col("sha256").alias("capture_id"), "sha256", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"), "path")


def classify_captures(files: DataFrame, max_bytes: int) -> DataFrame:
    """A ceiling of zero means no ceiling."""
    size = F.col("size_bytes")
    over = (size > max_bytes) if max_bytes else F.lit(False)
    return files.withColumn("validation", F.when(size == 0, "EMPTY_FILE")
                            .when(over, "TOO_LARGE").otherwise("OK"))


def run_status(runs: DataFrame) -> DataFrame:
    """Dissection outcome and run status from exit code, packet count and the limit flag."""
    code, count = F.col("exit_code"), F.col("packet_count")
    outcome = (F.when(F.col("limit_exceeded"), "LIMIT_EXCEEDED")
               .when(code == 0, F.when(count > 0, "OK").otherwise("EMPTY"))
               .when(code == 14, "TRUNCATED").when(code == 3, "MALFORMED").otherwise("ERROR"))
    d = F.col("dissection_status")
    return (runs.withColumn("dissection_status", outcome)
            .withColumn("run_status", F.when(d == "OK", "COMPLETED")
                        .when(d.isin("TRUNCATED", "LIMIT_EXCEEDED"), "PARTIAL")
                        .when(d == "EMPTY", "EMPTY").otherwise("FAILED"))
            .withColumn("warning", F.when(d == "TRUNCATED", "capture is truncated")
                        .when(d == "LIMIT_EXCEEDED", "frame ceiling reached")
                        .when(d == "EMPTY", "capture holds no packets")))


def summarize(frames: DataFrame) -> DataFrame:
    """Structural counts per capture."""
    is_type = lambda t: F.count_if(F.col("tls.handshake_type") == t)
    is_app = lambda p: F.count_if(F.col("app_protocol") == p)
    return frames.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.countDistinct("tcp_stream_id").alias("tcp_streams"),
        is_app("smtp").alias("smtp_frames"), is_app("imap").alias("imap_frames"),
        is_app("pop3").alias("pop3_frames"),
        F.count_if("tls.present").alias("tls_frames"),
        is_type(1).alias("client_hellos"), is_type(2).alias("server_hellos"),
        F.count_if("implicit_tls_port").alias("implicit_tls_frames"))


def handshake_histogram(frames: DataFrame) -> DataFrame:
    return (frames.filter(F.col("tls.handshake_type").isNotNull())
            .groupBy("capture_id", F.col("tls.handshake_type").alias("handshake_type"))
            .agg(F.count(F.lit(1)).alias("frames")))
