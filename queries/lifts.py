"""The given tables, read as mail-traffic tables.

Each lift is one SELECT that both engines run; the few functions that are spelled differently
come from the dialect object.  Spark reads a lift as a DataFrame, the checks use the same text
as the first common table expression of their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepost.functions import evidence as ev

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Duck:
    days = staticmethod(lambda x: f"({x} - DATE '1970-01-01')")
    hex4 = staticmethod(lambda x: f"printf('0x%04x', {x})")
    hex2 = staticmethod(lambda x: f"lower(hex({x}))")
    epoch = staticmethod(lambda x: f"(epoch_us({x}) / 1000000.0)")
    split = staticmethod(lambda x: f"string_split({x}, '|')")
    sha = staticmethod(lambda x: f"sha256({x})")
    explode = staticmethod(lambda x: f"unnest({x})")


class Spark:
    days = staticmethod(lambda x: f"datediff({x}, DATE '1970-01-01')")
    hex4 = staticmethod(lambda x: f"format_string('0x%04x', {x})")
    hex2 = staticmethod(lambda x: f"lower(hex({x}))")
    epoch = staticmethod(lambda x: f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {x}) / 1000000.0D)")
    split = staticmethod(lambda x: f"split({x}, '[|]')")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    explode = staticmethod(lambda x: f"explode({x})")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


# --------------------------------------------------------------------------------- sessions
def seeds_sql(d) -> str:
    """orders joined to customer: the few numbers of a session from which the rest is worked out."""
    return f"""
    SELECT o_orderkey AS sid, o_custkey AS cust, c_nationkey AS nat, o_orderstatus AS os,
      {d.days('CAST(o_orderdate AS DATE)')} AS day_no,
      CASE WHEN c_nationkey % 6 = 0 THEN CASE WHEN o_custkey % 40 = 12 THEN 12 ELSE 1 END
           WHEN o_custkey % 2 = 0 AND o_orderkey % 11 <> 0 THEN o_custkey ELSE o_orderkey END AS h
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def sessions_sql(d, seeds: str | None = None, more: str = "") -> str:
    """`h` seeds the behaviour of a session.  `seeds` names a relation that has the seeds already, `more` columns
    of it that come along."""
    seeds = f"({seeds_sql(d)})" if seeds is None else seeds
    return f"""
SELECT 'cap' || CAST(nat % 5 AS STRING) AS capture_id, sid AS tcp_stream_id,
  'cap' || CAST(nat % 5 AS STRING) || ':' || CAST(sid AS STRING) AS stream_key,
  CASE WHEN cust % 13 = 0 THEN NULL WHEN cust % 3 = 0 THEN 'smtp' WHEN cust % 3 = 1 THEN 'imap'
       ELSE 'pop3' END AS protocol,
  CASE WHEN cust % 17 = 0 THEN NULL ELSE 'c' || CAST(cust % 40 AS STRING) END AS client_ip,
  CAST(40000 + cust % 1000 AS INT) AS client_port,
  's' || CAST(nat AS STRING) AS server_ip,
  CAST(CASE WHEN cust % 3 = 0 THEN 587 WHEN cust % 3 = 1 THEN 143 ELSE 110 END AS INT) AS server_port,
  implicit_tls,
  CASE WHEN sid % 97 = 0 THEN NULL ELSE day_no * CAST(86400 AS DOUBLE) END AS start_epoch,
  CASE WHEN sid % 97 = 0 THEN NULL ELSE day_no * CAST(86400 AS DOUBLE) + h % 300 END AS end_epoch,
  sid * 10 AS first_frame, sid * 10 + h % 50 AS last_frame, h % 60 AS packet_count,
  CASE WHEN os = 'F' THEN 'COMPLETE' WHEN sid % 19 = 0 THEN 'TRUNCATED' ELSE 'INCOMPLETE' END AS completeness,
  CASE WHEN implicit_tls THEN 'IMPLICIT_TLS' WHEN h % 4 = 0 AND h % 6 <> 2 THEN 'PLAINTEXT_CONTINUATION'
       WHEN h % 4 = 0 THEN 'CAPABILITY_OBSERVED' WHEN h % 4 = 3 THEN 'TLS_NEGOTIATING'
       ELSE 'TLS_ESTABLISHED' END AS app_state,
  CASE WHEN h % 4 = 0 THEN 'NONE' WHEN h % 4 = 3 THEN 'SERVER_HELLO_OBSERVED' ELSE 'ESTABLISHED' END AS tls_state,
  (os <> 'O') AS setup, (os = 'F') AS teardown, (os = 'F' AND h % 9 = 0) AS reset,
  CASE WHEN implicit_tls THEN NULL WHEN h % 3 = 0 THEN 'false' WHEN h % 3 = 1 THEN 'true' END AS adv_value,
  CASE WHEN implicit_tls THEN 'NOT_OBSERVABLE' WHEN h % 3 = 0 THEN 'AMBIGUOUS'
       WHEN h % 3 = 1 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS adv_state,
  CASE WHEN implicit_tls THEN NULL WHEN wants THEN 'true' ELSE 'false' END AS req_value,
  CASE WHEN implicit_tls THEN 'NOT_OBSERVABLE' ELSE 'OBSERVED' END AS req_state,
  CASE WHEN implicit_tls OR NOT wants THEN NULL WHEN h % 5 = 1 THEN 'false'
       WHEN h % 5 IN (0, 3) THEN 'true' END AS acc_value,
  CASE WHEN implicit_tls THEN 'NOT_OBSERVABLE' WHEN NOT wants THEN 'UNKNOWN' WHEN h % 5 = 2 THEN 'AMBIGUOUS'
       WHEN h % 5 IN (0, 1, 3) THEN 'OBSERVED' ELSE 'UNKNOWN' END AS acc_state,
  CASE WHEN h % 4 = 0 AND NOT implicit_tls THEN 'false' WHEN h % 4 IN (1, 2) AND h % 29 <> 1 THEN 'true' END AS tt_value,
  CASE WHEN h % 4 = 0 AND NOT implicit_tls THEN 'OBSERVED' WHEN h % 4 IN (1, 2) AND h % 29 <> 1 THEN 'OBSERVED'
       ELSE 'AMBIGUOUS' END AS tt_state,
  CASE WHEN h % 4 = 0 OR h % 31 = 7 OR h % 41 = 3 THEN NULL WHEN h % 37 = 5 THEN 'DTLS1.2' WHEN h % 5 = 0 THEN 'TLS1.0'
       WHEN h % 5 = 1 THEN 'TLS1.2' WHEN h % 23 = 0 THEN 'SSL3.0' ELSE 'TLS1.3' END AS ver_value,
  CASE WHEN h % 4 = 0 OR h % 41 = 3 THEN 'UNKNOWN' WHEN h % 31 = 7 THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS ver_state,
  CASE WHEN h % 4 <> 0 AND h % 41 <> 3 THEN {d.hex4('suite')} END AS cip_value,
  CASE WHEN h % 4 <> 0 AND h % 41 <> 3 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS cip_state,
  CASE WHEN h % 4 <> 0 AND h % 41 <> 3 THEN suite END AS suite_code,
  CAST(CASE WHEN h % 4 = 0 OR h % 41 = 3 THEN NULL WHEN h % 7 = 0 THEN 29 WHEN h % 7 = 1 THEN 23
       WHEN h % 7 = 2 THEN 24 WHEN h % 7 = 3 THEN 999 END AS INT) AS group_code,
  CASE WHEN implicit_tls THEN 'false' WHEN h % 4 = 0 AND h % 6 <> 2 THEN 'true' ELSE 'false' END AS pc_value,
  'OBSERVED' AS pc_state,
  CASE WHEN implicit_tls THEN NULL WHEN (h % 4 = 0 AND h % 6 <> 2) OR h % 25 = 6 THEN 'true' ELSE 'false' END AS auth_value,
  CASE WHEN implicit_tls THEN 'NOT_OBSERVABLE' ELSE 'OBSERVED' END AS auth_state,
  h % 12 AS n_events, h % 6 AS n_event_kinds, h % 7 AS n_transitions,
  (h % 12 > 1) AS has_greeting, (h % 12 > 3) AS has_capability, h % 12 - h % 5 % (h % 12 + 1) AS c2s_events,
  h % 5 % (h % 12 + 1) AS s2c_events,
  CASE WHEN (h % 4 = 0 AND h % 6 <> 2) OR h % 25 = 6 THEN sid * 10 + 7 END AS first_auth_frame,
  CASE WHEN h % 4 <> 0 THEN sid * 10 + CASE WHEN h % 2 = 0 THEN 5 ELSE 9 END END AS first_tls_frame{more}
FROM (
  SELECT b.*, (cust % 7 = 0) AS implicit_tls, (h % 3 = 1 AND h % 4 <> 0) AS wants,
    CAST(CASE h % 6 WHEN 0 THEN 4865 WHEN 1 THEN 49199 WHEN 2 THEN 156 WHEN 3 THEN 5
         WHEN 4 THEN 49156 ELSE 64250 END AS INT) AS suite
  FROM {seeds} b) x"""


PLACE = """row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_shipdate, l_extendedprice)"""


def certificates_sql(d, place: str = PLACE, source: str = "lineitem") -> str:
    """lineitem as certificates of the stream with the same key."""
    return f"""
  SELECT l_orderkey AS tcp_stream_id,
    CAST({place} - 1 AS INT) AS idx,
    CAST(CASE l_partkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 END AS INT) AS key_bits,
    CASE WHEN l_partkey % 19 = 0 THEN NULL
         ELSE CAST({d.days('CAST(l_shipdate AS DATE)')} AS BIGINT) * 86400 - 86400 * 200 END AS not_before,
    CAST({d.days('CAST(l_shipdate AS DATE)')} AS BIGINT) * 86400 + CAST(l_quantity AS BIGINT) * 864000 AS not_after,
    CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'k' || CAST(l_suppkey % 5 AS STRING) END AS ski,
    'k' || CAST(l_partkey % 5 AS STRING) AS aki,
    CASE l_returnflag WHEN 'A' THEN '1.2.840.113549.1.1.11' WHEN 'N' THEN '1.2.840.113549.1.1.5'
         ELSE '1.2.3.4' END AS sig_oid
  FROM {source}"""


def flat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders", "customer")
    return spark.sql(sessions_sql(Spark))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are numbered before anything is worked out of them: beside a window Spark works out all columns
    below its shuffle, and then takes the renamed stream for another key than the one it has dealt rows by."""
    register(spark, sf_dir, "lineitem")
    return spark.sql(certificates_sql(Spark, "place", f"(SELECT *, {PLACE} AS place FROM lineitem) numbered"))


#: evidence field -> (flat column prefix, frame offset)
FIELD_LAYOUT = {
    "starttls_advertised": ("adv", 2), "starttls_requested": ("req", 3),
    "starttls_accepted": ("acc", 4), "tls_transition": ("tt", 5),
    "tls_negotiated_version": ("ver", 6), "tls_cipher_suite": ("cip", 6),
    "plaintext_continuation": ("pc", 7), "auth_activity": ("auth", 7),
}


def _field(prefix: str, offset: int):
    value, state = F.col(f"{prefix}_value"), F.col(f"{prefix}_state")
    has = state.isin("OBSERVED", "AMBIGUOUS") & (F.coalesce(value, F.lit("")) != "false")
    width = F.col("packet_count") % 3 if prefix == "tt" else F.lit(0)
    lo = F.when(has, F.col("first_frame") + offset)
    return ev.build(value, state, F.concat(F.lit(f"{prefix} read as "), state),
                    F.when(state == "OBSERVED", "observed").otherwise("none"),
                    (lo, lo + width, F.when(has, width + 1).otherwise(0)))


CHAIN = ["certificates", "chain_links", "chain_signature_oids"]


def chained_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sessions with the chain of their stream.  Only the seeds of a session travel to its chain."""
    from wirepost.operators import crypto
    register(spark, sf_dir, "orders", "customer")
    chains = crypto.chain_arrays(certificates(spark, sf_dir), ["tcp_stream_id"])
    spark.sql(seeds_sql(Spark)).join(chains.withColumnRenamed("tcp_stream_id", "sid"), "sid", "left").createOrReplaceTempView("seeds_chained")
    return spark.sql(sessions_sql(Spark, "seeds_chained", "".join(f", {c}" for c in CHAIN)))


def sessions(spark: SparkSession, sf_dir: str, crypto: bool = False,
             with_certificates: bool = False) -> DataFrame:
    """The lift in the session schema the operators read."""
    flat = chained_sessions(spark, sf_dir) if with_certificates else flat_sessions(spark, sf_dir)
    used = {f"{p}_{part}" for p, _ in FIELD_LAYOUT.values() for part in ("value", "state")}
    out = flat.select(*[c for c in flat.columns if c not in used],
                      *[_field(p, off).alias(f) for f, (p, off) in FIELD_LAYOUT.items()])
    if with_certificates:
        visible = (F.col("tls_state") != "NONE") & \
            (F.coalesce(F.col("tls_negotiated_version.value"), F.lit("")) != "TLS1.3")
        out = out.select("tcp_stream_id", *[c for c in out.columns if c not in (*CHAIN, "tcp_stream_id")],
                         *[F.when(visible, F.col(c)).alias(c) for c in CHAIN])
    if crypto or with_certificates:
        from wirepost.operators import crypto as cr
        out = cr.enrich_sessions(spark, out)
    return out


# ----------------------------------------------------------------------------------- frames
def frames_sql(d) -> str:
    """events as dissected frames, with the text a dissector would report."""
    hs1, hs2, app = "e % 9 = 0", "e % 9 = 1", "e % 9 = 2"
    cert = "e % 9 = 1 AND e % 4 < 3 AND e % 41 <> 0"
    return f"""
SELECT 'cap' || CAST(u % 3 AS STRING) AS capture_id, e AS frame_number, sid AS tcp_stream_id,
  'cap' || CAST(u % 3 AS STRING) || ':' || CAST(sid AS STRING) AS stream_key,
  t AS timestamp_epoch,
  CASE WHEN srv THEN sip ELSE cip END AS src_ip, CASE WHEN srv THEN cip ELSE sip END AS dst_ip,
  CAST(CASE WHEN srv THEN sport ELSE cport END AS INT) AS src_port,
  CAST(CASE WHEN srv THEN cport ELSE sport END AS INT) AS dst_port,
  CASE WHEN e % 17 = 0 THEN NULL ELSE (e % 5) * 100 + CASE WHEN srv THEN 7 ELSE 0 END END AS tcp_seq,
  CASE WHEN e % 7 = 0 THEN '0x0002' WHEN e % 5 = 0 THEN '18' WHEN e % 31 = 0 THEN '0x0011'
       WHEN e % 37 = 0 THEN '4' ELSE '0x0018' END AS tcp_flags,
  'eth:ethertype:ip:tcp' || CASE WHEN imp OR tlsy THEN ':tls' WHEN e % 10 = 3 THEN ''
       ELSE ':' || CASE pr WHEN 'pop3' THEN 'pop' ELSE pr END END AS stack,
  CASE WHEN imp OR tlsy OR e % 10 = 3 THEN NULL ELSE pr END AS app_protocol,
  CASE WHEN tlsy THEN '0x0303' END AS record_version,
  CAST(CASE WHEN {hs1} THEN 1 WHEN {hs2} THEN 2 END AS INT) AS handshake_type,
  CASE WHEN {hs2} THEN CASE e % 4 WHEN 0 THEN '772' WHEN 2 THEN '0x0304' WHEN 3 THEN '770' END END AS supported_version,
  CASE WHEN {hs2} THEN CASE e % 5 WHEN 0 THEN '769' WHEN 1 THEN NULL ELSE '771' END END AS handshake_version,
  CASE WHEN {hs2} THEN CASE e % 6 WHEN 0 THEN '4865' WHEN 1 THEN '49199' WHEN 2 THEN '156' WHEN 3 THEN '0x1302'
       WHEN 4 THEN NULL ELSE '64250' END END AS cipher_suite,
  CASE WHEN {hs2} THEN CASE e % 7 WHEN 0 THEN '29' WHEN 1 THEN '0x0017' WHEN 2 THEN '999' END END AS key_share_group,
  ({app}) AS has_app_data, tlsy AS tls_present,
  CASE WHEN {cert} THEN 'sn' || CAST(e AS STRING) END AS cert_serial, CASE WHEN {cert} THEN 'k' || CAST(e % 3 AS STRING) END AS cert_ski,
  CASE WHEN {cert} THEN 'k' || CAST(e % 2 AS STRING) END AS cert_aki,
  CASE WHEN {cert} THEN CASE WHEN e % 4 = 0 THEN '1.2.840.113549.1.1.11' ELSE '1.2.840.113549.1.1.5' END END AS cert_oid,
  CASE WHEN plain AND pr = 'smtp' AND e % 23 <> 0 THEN CASE ty WHEN 'view' THEN 'EHLO client.example'
       WHEN 'purchase' THEN CASE e % 3 WHEN 0 THEN 'auth plain' WHEN 1 THEN 'STARTTLS' ELSE 'MAIL FROM:<a@b>' END END END AS smtp_command_line,
  CASE WHEN plain AND pr = 'smtp' THEN CASE ty WHEN 'view' THEN 'EHLO'
       WHEN 'purchase' THEN CASE e % 3 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'STAR' ELSE 'MAIL' END END END AS smtp_command,
  CASE WHEN plain AND pr = 'smtp' THEN CASE ty WHEN 'signup' THEN '220' WHEN 'click' THEN '250'
       WHEN 'error' THEN CASE WHEN e % 2 = 0 THEN '220' ELSE '454' END END END AS smtp_response_code,
  CASE WHEN plain AND pr = 'smtp' THEN CASE ty WHEN 'signup' THEN 'mail.example.org ESMTP'
       WHEN 'click' THEN CASE WHEN e % 4 = 0 THEN 'mail|PIPELINING|STARTTLS' ELSE 'mail|PIPELINING' END
       WHEN 'error' THEN CASE WHEN e % 2 = 0 THEN '2.0.0 Ready to start TLS' ELSE '4.7.0 no' END END END AS smtp_params_text,
  CASE WHEN plain AND pr = 'imap' THEN CASE ty WHEN 'view' THEN 'CAPABILITY'
       WHEN 'purchase' THEN CASE e % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'STARTTLS' ELSE 'SELECT' END END END AS imap_command,
  CASE WHEN plain AND pr = 'imap' AND ty = 'error' THEN CASE WHEN e % 2 = 0 THEN 'OK' ELSE 'NO' END END AS imap_response_status,
  CASE WHEN plain AND pr = 'imap' THEN CASE ty WHEN 'signup' THEN '* OK IMAP ready'
       WHEN 'click' THEN CASE WHEN e % 8 = 1 THEN ' * OK hi|* CAPABILITY IMAP4' WHEN e % 4 = 0 THEN '* CAPABILITY IMAP4rev1 STARTTLS'
                         ELSE '* CAPABILITY IMAP4rev1' END
       WHEN 'error' THEN CASE WHEN e % 2 = 0 THEN 'a1 OK Begin TLS negotiation' ELSE 'a1 NO STARTTLS refused' END END END AS imap_lines_text,
  CASE WHEN plain AND pr = 'pop3' THEN CASE ty WHEN 'view' THEN 'CAPA'
       WHEN 'purchase' THEN CASE e % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'stls' ELSE 'LIST' END END END AS pop_command,
  CASE WHEN plain AND pr = 'pop3' THEN CASE ty WHEN 'signup' THEN '+OK' WHEN 'click' THEN '+OK'
       WHEN 'error' THEN CASE WHEN e % 2 = 0 THEN '+OK' ELSE '-ERR' END END END AS pop_response_indicator,
  CASE WHEN plain AND pr = 'pop3' THEN CASE ty WHEN 'signup' THEN 'POP3 ready'
       WHEN 'click' THEN CASE WHEN e % 4 = 0 THEN 'Capability list follows' END
       WHEN 'error' THEN CASE WHEN e % 2 = 0 THEN 'Begin TLS negotiation' ELSE 'not supported' END END END AS pop_response_description,
  CASE WHEN NOT plain THEN NULL
       WHEN pr = 'pop3' AND ty = 'click' THEN '+OK' || chr(13) || chr(10) || CASE WHEN e % 4 = 0 THEN 'STLS' ELSE 'TOP' END || chr(13) || chr(10) || '.'
       WHEN pr = 'smtp' AND srv THEN CASE e % 5 WHEN 0 THEN '250-mail' || chr(13) || chr(10) WHEN 1 THEN '250-STAR'
            WHEN 2 THEN 'TTLS' || chr(13) || chr(10) WHEN 3 THEN '250-STARTTLS ' || chr(13) || chr(10) || '250 OK' || chr(13) || chr(10)
            ELSE '250 HELP' || chr(13) || chr(10) END END AS payload_text
FROM (
  SELECT event_id AS e, user_id AS u, event_type AS ty, {d.epoch('ts')} AS t,
    user_id * 8 + CAST(floor(DAY(ts) / 4) AS BIGINT) AS sid,
    CASE WHEN user_id % 3 = 0 THEN 'smtp' WHEN user_id % 3 = 1 THEN 'imap' ELSE 'pop3' END AS pr,
    (event_type IN ('signup', 'click', 'error')) AS srv,
    'c' || CAST(user_id AS STRING) AS cip, 's' || CAST(user_id % 4 AS STRING) AS sip,
    40000 + user_id AS cport, (user_id % 11 = 0) AS imp,
    CASE WHEN user_id % 13 = 5 THEN 9999
         WHEN user_id % 11 = 0 THEN CASE user_id % 3 WHEN 0 THEN 465 WHEN 1 THEN 993 ELSE 995 END
         ELSE CASE user_id % 3 WHEN 0 THEN 587 WHEN 1 THEN 143 ELSE 110 END END AS sport,
    ({hs1.replace('e %', 'event_id %')} OR {hs2.replace('e %', 'event_id %')} OR {app.replace('e %', 'event_id %')}) AS tlsy,
    (user_id % 11 <> 0 AND event_id % 9 > 2 AND event_id % 10 <> 3) AS plain
  FROM events) x"""


#: certificate fields of the frame lift
X509 = {"serials": "cert_serial", "subject_key_ids": "cert_ski", "authority_key_ids": "cert_aki", "algorithm_ids": "cert_oid"}


def flat_frames(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """`dealt` deals the short rows of the events to all tasks before each becomes a packet's worth of text,
    as a file of a few splits would else be dissected by a few tasks."""
    register(spark, sf_dir, "events")
    if dealt:
        events = spark.table("events")
        events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id", "ts").createOrReplaceTempView("events")
    return spark.sql(frames_sql(Spark))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift in the frame schema that `sources.ek.project_frames` produces."""
    f = flat_frames(spark, sf_dir)
    ports = [465, 993, 995]
    def listed(c):
        return F.when(F.col(c).isNull(), F.array().cast("array<string>")) \
            .otherwise(F.split(c, "[|]"))
    return f.select(
        "capture_id", "frame_number", "tcp_stream_id", "timestamp_epoch", "src_ip", "dst_ip",
        "src_port", "dst_port", F.lit("tcp").alias("transport"), "tcp_seq", "tcp_flags",
        F.split("stack", ":").alias("protocol_stack"), "app_protocol",
        (F.col("dst_port").isin(ports) | F.col("src_port").isin(ports)).alias("implicit_tls_port"),
        F.struct("record_version", "handshake_type", "handshake_version", "cipher_suite",
                 F.lit(None).cast("string").alias("sni"), "supported_version",
                 F.lit(None).cast("string").alias("session_id"), "has_app_data",
                 "key_share_group", F.when(F.col("cert_serial").isNotNull(), F.create_map(*[
                     x for name, c in X509.items() for x in (F.lit(name), F.array(c))])).alias("x509"),
                 F.col("tls_present").alias("present")).alias("tls"),
        F.struct("smtp_command", "smtp_command_line", "smtp_response_code",
                 listed("smtp_params_text").alias("smtp_response_params"),
                 "imap_command", "imap_response_status",
                 listed("imap_lines_text").alias("imap_lines"), "pop_command",
                 "pop_response_indicator", "pop_response_description").alias("mail"),
        "payload_text", "stream_key")


def ek_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames rendered as dissector JSON text, one packet a line; every seventh packet
    is preceded by an index line and every eleventh by a broken one."""
    f = flat_frames(spark, sf_dir, dealt=True)
    layers = F.struct(
        F.struct(F.col("frame_number").cast("string").alias("frame_frame_number"),
                 F.when(F.col("frame_number") % 2 == 0, F.col("timestamp_epoch").cast("decimal(20,6)").cast("string"))
                  .otherwise(F.date_format(F.timestamp_micros((F.col("timestamp_epoch") * 1000000).cast("bigint")),
                                           "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")).alias("frame_frame_time_epoch"),
                 F.col("stack").alias("frame_frame_protocols")).alias("frame"),
        F.struct(F.when(F.col("frame_number") % 3 != 0, F.col("src_ip")).alias("ip_ip_src"),
                 F.when(F.col("frame_number") % 3 != 0, F.col("dst_ip")).alias("ip_ip_dst")).alias("ip"),
        F.struct(F.when(F.col("frame_number") % 3 == 0, F.col("src_ip")).alias("ipv6_ipv6_src"),
                 F.when(F.col("frame_number") % 3 == 0, F.col("dst_ip")).alias("ipv6_ipv6_dst")).alias("ipv6"),
        F.struct(F.array(F.col("src_port").cast("string")).alias("tcp_tcp_srcport"),
                 F.col("dst_port").cast("string").alias("tcp_tcp_dstport"),
                 F.when(F.col("frame_number") % 41 != 0, F.col("tcp_stream_id").cast("string")).alias("tcp_tcp_stream"),
                 F.col("tcp_seq").cast("string").alias("tcp_tcp_seq"),
                 F.col("tcp_flags").alias("tcp_tcp_flags"),
                 F.when(F.col("payload_text").isNotNull(), F.regexp_replace(
                     F.lower(F.hex("payload_text")), "(..)(?!$)", "$1:")).alias("tcp_tcp_payload")).alias("tcp"),
        F.struct(F.col("record_version").alias("tls_tls_record_version"),
                 F.col("handshake_type").cast("string").alias("tls_tls_handshake_type"),
                 F.col("handshake_version").alias("tls_tls_handshake_version"),
                 F.col("supported_version").alias("tls_tls_handshake_extensions_supported_version"),
                 F.col("cipher_suite").alias("tls_tls_handshake_ciphersuite"),
                 F.col("key_share_group").alias("tls_tls_handshake_extensions_key_share_group"),
                 F.when(F.col("has_app_data"), F.lit("17:03")).alias("tls_tls_app_data")).alias("tls"),
        F.when(F.col("cert_serial").isNotNull(), F.struct(
            F.array("cert_serial").alias("x509af_x509af_serialNumber"), F.col("cert_oid").alias("x509af_x509af_algorithm_id"),
            F.col("cert_ski").alias("x509ce_x509ce_SubjectKeyIdentifier"), F.col("cert_aki").alias("x509ce_x509ce_keyIdentifier"))).alias("x509af"),
        F.struct(F.col("smtp_command").alias("smtp_smtp_req_command"),
                 F.col("smtp_command_line").alias("smtp_smtp_command_line"),
                 F.col("smtp_response_code").alias("smtp_smtp_response_code"),
                 F.split("smtp_params_text", "[|]").alias("smtp_smtp_rsp_parameter")).alias("smtp"),
        F.struct(F.col("imap_command").alias("imap_imap_request_command"),
                 F.col("imap_response_status").alias("imap_imap_response_status"),
                 F.split("imap_lines_text", "[|]").alias("imap_imap_line")).alias("imap"),
        F.col("pop_command").alias("pop_pop_request_command"),
        F.col("pop_response_indicator").alias("pop_pop_response_indicator"),
        F.col("pop_response_description").alias("pop_pop_response_description"))
    line = F.to_json(F.struct(F.lit("1").alias("timestamp"), layers.alias("layers")))
    n = F.col("frame_number")
    return f.select("capture_id", F.explode(F.array_compact(F.array(
        F.when(n % 7 == 0, F.lit('{"index":{"_index":"packets"}}')),
        F.when(n % 11 == 0, F.lit('{"timestamp": "broken')), line))).alias("value"))
