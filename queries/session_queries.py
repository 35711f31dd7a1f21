"""Reading dissected packets, and rebuilding sessions from frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import lifts
from queries.base import DIM_GROUP, DIM_SUITE, FR, query, values
from wirepost.functions import casts, vocab
from wirepost.operators import marts
from wirepost.operators import sessions as se
from wirepost.sources import ek


def parsed(spark, sf):
    return ek.parse_ek(lifts.ek_lines(spark, sf))


def projected(spark, sf):
    return ek.frames_from(parsed(spark, sf))


STREAM_ID = "CASE WHEN frame_number % 41 <> 0 THEN tcp_stream_id END"


@query("parse_ek", f"WITH {FR} SELECT capture_id, count(*) AS packets FROM fr GROUP BY 1")
def parse_ek(spark, sf):
    return parsed(spark, sf).groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets"))


@query("flatten_layers", f"""WITH {FR} SELECT CAST(frame_number AS VARCHAR) AS frame_number, stack, pop_command,
  src_ip AS ip FROM fr""")
def flatten_layers(spark, sf):
    flat = F.col("flat")
    return ek.flatten_layers(parsed(spark, sf)).select(
        flat["frame_frame_number"].alias("frame_number"), flat["frame_frame_protocols"].alias("stack"),
        flat["pop_pop_request_command"].alias("pop_command"),
        F.coalesce(flat["ip_ip_src"], flat["ipv6_ipv6_src"]).alias("ip"))


@query("pick", f"WITH {FR} SELECT frame_number, src_ip, src_port, split_part(smtp_params_text, '|', 1) AS first_param FROM fr")
def pick(spark, sf):
    f = ek.flatten_layers(parsed(spark, sf))
    return f.select(casts.to_int(casts.pick("flat", ["frame_frame_number"])).alias("frame_number"),
                    casts.pick("flat", vocab.FIELD_NAMES["src_ip"]).alias("src_ip"),
                    casts.to_int(casts.pick("flat", vocab.FIELD_NAMES["src_port"])).alias("src_port"),
                    casts.pick("flat", vocab.FIELD_NAMES["smtp_response_params"]).alias("first_param"))


@query("pick_all", f"WITH {FR} SELECT frame_number, coalesce(smtp_params_text, '') AS params, coalesce(imap_lines_text, '') AS lines FROM fr")
def pick_all(spark, sf):
    f = ek.flatten_layers(parsed(spark, sf))
    joined = lambda n: F.array_join(casts.pick_all("flat", vocab.FIELD_NAMES[n]), "|")
    return f.select(casts.to_int(casts.pick("flat", ["frame_frame_number"])).alias("frame_number"),
                    joined("smtp_response_params").alias("params"), joined("imap_lines").alias("lines"))


_FLAGS = "CASE tcp_flags WHEN '0x0002' THEN 2 WHEN '18' THEN 18 WHEN '0x0011' THEN 17 WHEN '4' THEN 4 ELSE 24 END"


@query("safe_casts", f"WITH {FR} SELECT frame_number, {_FLAGS} AS flags, CASE WHEN supported_version NOT LIKE '0x%' THEN try_cast(supported_version AS BIGINT) END AS decimal_version, round(timestamp_epoch, 6) AS epoch, try_cast(stack AS DOUBLE) AS not_a_number FROM fr")
def safe_casts(spark, sf):
    f = projected(spark, sf)
    return f.select("frame_number", casts.to_int(F.col("tcp_flags")).alias("flags"),
                    casts.to_int_decimal(F.col("tls.supported_version")).alias("decimal_version"),
                    F.round("timestamp_epoch", 6).alias("epoch"),
                    casts.to_float(F.array_join("protocol_stack", ":")).alias("not_a_number"))


@query("decode_payload", f"WITH {FR} SELECT frame_number, payload_text FROM fr")
def decode_payload(spark, sf):
    return projected(spark, sf).select("frame_number", "payload_text")


@query("decode_documents", "SELECT doc_id, nullif(text, '') AS payload FROM documents")
def decode_documents(spark, sf):
    """Whole texts through the payload decoder."""
    lifts.register(spark, sf, "documents")
    d = spark.table("documents")
    colons = F.regexp_replace(F.hex("text"), "(..)(?!$)", "$1:")
    return d.select("doc_id", casts.decode_payload(colons).alias("payload"))


@query("app_protocol", f"WITH {FR} SELECT frame_number, app_protocol FROM fr")
def app_protocol(spark, sf):
    return projected(spark, sf).select("frame_number", "app_protocol")


_MAIL = "(465, 993, 995, 25, 587, 143, 110)"


@query("implicit_port", f"WITH {FR} SELECT frame_number, (src_port IN (465, 993, 995) OR dst_port IN (465, 993, 995)) AS implicit_tls_port FROM fr")
def implicit_port(spark, sf):
    return projected(spark, sf).select("frame_number", "implicit_tls_port")


@query("missing_fields", f"WITH {FR} SELECT frame_number, CASE WHEN frame_number % 41 = 0 THEN 'tcp_stream' ELSE '' END AS missing FROM fr")
def missing_fields(spark, sf):
    return projected(spark, sf).select("frame_number", F.array_join("missing", ",").alias("missing"))


@query("keep_payload", f"""WITH {FR} SELECT frame_number, (app_protocol IS NOT NULL OR ((src_port IN {_MAIL} OR dst_port IN {_MAIL})
  AND stack NOT LIKE '%:tls%')) AS keep FROM fr""")
def keep_payload(spark, sf):
    return projected(spark, sf).select("frame_number", ek.keep_payload().alias("keep"))


@query("stream_key", f"WITH {FR} SELECT frame_number, capture_id || ':' || CAST({STREAM_ID} AS VARCHAR) AS stream_key FROM fr")
def stream_key(spark, sf):
    return projected(spark, sf).select("frame_number", "stream_key")


@query("project_frames", f"""WITH {FR} SELECT capture_id, frame_number, {STREAM_ID} AS tcp_stream_id, src_ip, dst_ip, src_port, dst_port, tcp_seq, stack, app_protocol,
  handshake_type, cipher_suite, key_share_group, has_app_data, (record_version IS NOT NULL OR handshake_type IS NOT NULL OR cipher_suite IS NOT NULL OR has_app_data) AS present,
  smtp_command_line, imap_response_status, pop_response_description, payload_text IS NOT NULL AS has_payload, cert_serial, cert_oid FROM fr""")
def project_frames(spark, sf):
    return projected(spark, sf).select(
        "capture_id", "frame_number", "tcp_stream_id", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_seq",
        F.array_join("protocol_stack", ":").alias("stack"), "app_protocol", "tls.handshake_type", "tls.cipher_suite",
        "tls.key_share_group", "tls.has_app_data", "tls.present", "mail.smtp_command_line", "mail.imap_response_status",
        "mail.pop_response_description", "has_payload", F.col("tls.x509")["serials"][0].alias("cert_serial"),
        F.col("tls.x509")["algorithm_ids"][0].alias("cert_oid"))


@query("flag_ceiling", f"WITH {FR} SELECT capture_id, frame_number, count(*) OVER (PARTITION BY capture_id) > 1500 AS limit_exceeded FROM fr")
def flag_ceiling(spark, sf):
    return ek.flag_ceiling(lifts.frames(spark, sf), 1500).select("capture_id", "frame_number", "limit_exceeded")


@query("cap_frames", f"""WITH {FR}, n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_number) AS rn, count(*) OVER (PARTITION BY capture_id) AS total FROM fr)
  SELECT capture_id, frame_number, total > 1500 AS limit_exceeded FROM n WHERE rn <= 1500""")
def cap_frames(spark, sf):
    """The cut is what this operator is asked for; `flag_ceiling` keeps every frame."""
    return ek.cap_frames(lifts.frames(spark, sf), 1500).select("capture_id", "frame_number", "limit_exceeded")


@query("summarize", f"""WITH {FR} SELECT capture_id, count(*) AS frames, count(DISTINCT tcp_stream_id) AS tcp_streams,
  count(CASE WHEN app_protocol = 'smtp' THEN 1 END) AS smtp_frames, count(CASE WHEN app_protocol = 'imap' THEN 1 END) AS imap_frames,
  count(CASE WHEN app_protocol = 'pop3' THEN 1 END) AS pop3_frames, count(CASE WHEN tls_present THEN 1 END) AS tls_frames,
  count(CASE WHEN handshake_type = 1 THEN 1 END) AS client_hellos, count(CASE WHEN handshake_type = 2 THEN 1 END) AS server_hellos,
  count(CASE WHEN src_port IN (465, 993, 995) OR dst_port IN (465, 993, 995) THEN 1 END) AS implicit_tls_frames FROM fr GROUP BY 1""")
def summarize(spark, sf):
    return ek.summarize(lifts.frames(spark, sf))


@query("handshake_histogram", f"WITH {FR} SELECT capture_id, handshake_type, count(*) AS frames FROM fr WHERE handshake_type IS NOT NULL GROUP BY 1, 2")
def handshake_histogram(spark, sf):
    return ek.handshake_histogram(lifts.frames(spark, sf))


_RUNS = """SELECT o_orderkey AS run_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 14 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1 END AS INT) AS exit_code,
  o_custkey % 3 AS packet_count, (o_orderkey % 17 = 0) AS limit_exceeded FROM orders"""


@query("run_status", f"""WITH r AS ({_RUNS}), d AS (SELECT *, CASE WHEN limit_exceeded THEN 'LIMIT_EXCEEDED' WHEN exit_code = 0 AND packet_count > 0 THEN 'OK'
    WHEN exit_code = 0 THEN 'EMPTY' WHEN exit_code = 14 THEN 'TRUNCATED' WHEN exit_code = 3 THEN 'MALFORMED' ELSE 'ERROR' END AS dissection_status FROM r)
  SELECT run_id, dissection_status, CASE dissection_status WHEN 'OK' THEN 'COMPLETED' WHEN 'TRUNCATED' THEN 'PARTIAL' WHEN 'LIMIT_EXCEEDED' THEN 'PARTIAL'
    WHEN 'EMPTY' THEN 'EMPTY' ELSE 'FAILED' END AS run_status, dissection_status IN ('TRUNCATED', 'LIMIT_EXCEEDED', 'EMPTY') AS warned FROM d""")
def run_status(spark, sf):
    lifts.register(spark, sf, "orders")
    return ek.run_status(spark.sql(_RUNS)).select("run_id", "dissection_status", "run_status",
                                                  F.col("warning").isNotNull().alias("warned"))


@query("capture_catalog")
def capture_catalog(spark, sf):
    """Content hashes of the given files themselves."""
    return ek.capture_catalog(spark, f"{sf}/*.parquet").drop("path")


@query("classify_captures", "SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN 'EMPTY_FILE' WHEN n_chars > 1000 THEN 'TOO_LARGE' ELSE 'OK' END AS validation FROM documents")
def classify_captures(spark, sf):
    lifts.register(spark, sf, "documents")
    files = spark.table("documents").withColumn("size_bytes", F.when(F.col("n_chars") % 9 == 0, 0)
                                                .otherwise(F.col("n_chars")))
    return ek.classify_captures(files, 1000).select("doc_id", "validation")


# ------------------------------------------------------------------------------- the SQL side
_STREAM = "capture_id, tcp_stream_id"
_END = lambda a, b: f"{{'sip': {a}_ip, 'sport': {a}_port, 'cip': {b}_ip, 'cport': {b}_port}}"
_COMMAND = "upper(trim(coalesce(smtp_command_line, smtp_command)))"
FACTS = f"""{FR}, g AS (SELECT *, (smtp_response_code IS NOT NULL OR pop_response_indicator IS NOT NULL OR imap_response_status IS NOT NULL
    OR len(list_filter(string_split(coalesce(imap_lines_text, ''), '|'), lambda x: ltrim(x) LIKE '*%')) > 0) AS greet,
    {_FLAGS} AS fl, {_COMMAND} AS cmd FROM fr),
sf0 AS (SELECT {_STREAM}, min(frame_number) AS first_frame, max(frame_number) AS last_frame, min_by(timestamp_epoch, frame_number) AS start_epoch,
    max_by(timestamp_epoch, frame_number) AS end_epoch, count(*) AS packet_count, bool_or(src_port IN (465, 993, 995) OR dst_port IN (465, 993, 995)) AS implicit,
    coalesce(min_by({_END('src', 'dst')}, frame_number) FILTER (greet), min_by(CASE WHEN src_port IN {_MAIL} THEN {_END('src', 'dst')} ELSE {_END('dst', 'src')} END, frame_number)
      FILTER (src_port IN {_MAIL} OR dst_port IN {_MAIL})) AS rl, bool_or(greet) AS greeted,
    bool_or((fl & 2) <> 0 AND (fl & 16) = 0) AND bool_or((fl & 2) <> 0 AND (fl & 16) <> 0) AS setup, bool_or((fl & 1) <> 0) AS teardown, bool_or((fl & 4) <> 0) AS reset,
    bool_or(tls_present AND handshake_type = 1) AS ch, bool_or(tls_present AND handshake_type = 2) AS sh, bool_or(tls_present AND has_app_data) AS ap,
    count(CASE WHEN tls_present THEN 1 END) AS tls_n, min(CASE WHEN tls_present THEN frame_number END) AS tls_lo, max(CASE WHEN tls_present THEN frame_number END) AS tls_hi,
    min_by({{'sv': supported_version, 'hv': handshake_version, 'cs': cipher_suite, 'ks': key_share_group, 'fn': frame_number}}, frame_number) FILTER (handshake_type = 2) AS hello
  FROM g GROUP BY 1, 2),
vt AS (SELECT {_STREAM}, app_protocol, row_number() OVER (PARTITION BY {_STREAM} ORDER BY count(*) DESC, min(frame_number)) AS r FROM fr WHERE app_protocol IS NOT NULL GROUP BY 1, 2, 3),
sfx AS (SELECT sf0.*, rl.sip AS server_ip, rl.sport AS server_port, rl.cip AS client_ip, rl.cport AS client_port,
    coalesce(vt.app_protocol, CASE WHEN rl.sport IN (25, 587, 465) THEN 'smtp' WHEN rl.sport IN (143, 993) THEN 'imap' WHEN rl.sport IN (110, 995) THEN 'pop3' END) AS protocol,
    CASE WHEN tls_n = 0 THEN 'NONE' WHEN coalesce(ch, false) AND coalesce(sh, false) AND ap THEN 'ESTABLISHED' WHEN coalesce(ch, false) AND coalesce(sh, false) THEN 'SERVER_HELLO_OBSERVED'
      WHEN coalesce(ch, false) THEN 'CLIENT_HELLO_OBSERVED' ELSE 'HANDSHAKE_INTERRUPTED' END AS stream_tls,
    max(last_frame) OVER (PARTITION BY sf0.capture_id) AS capture_last_frame
  FROM sf0 LEFT JOIN vt ON r = 1 AND vt.capture_id = sf0.capture_id AND vt.tcp_stream_id = sf0.tcp_stream_id),
fd AS (SELECT g.*, protocol, implicit, CASE WHEN src_ip = server_ip AND src_port = server_port THEN 'SERVER_TO_CLIENT'
    WHEN dst_ip = server_ip AND dst_port = server_port THEN 'CLIENT_TO_SERVER' ELSE 'UNKNOWN' END AS direction FROM g JOIN sfx USING (capture_id, tcp_stream_id))"""
_EV = f"{_STREAM}, frame_number, direction, tcp_seq"
_NP = "len(string_split(smtp_params_text, '|'))"
_SM = "FROM fd WHERE NOT implicit AND protocol = 'smtp'"
_IM = "FROM il WHERE NOT implicit AND protocol = 'imap'"
_PO = "FROM po WHERE NOT implicit AND protocol = 'pop3'"
EVENTS = f"""{FACTS}, il AS (SELECT *, list_filter(list_transform(string_split(coalesce(imap_lines_text, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS ls,
    upper(trim(coalesce(imap_command, ''))) AS ic, upper(coalesce(imap_response_status, '')) AS ist FROM fd),
ix AS (SELECT *, upper(array_to_string(ls, ' ')) AS jn FROM il),
ill AS (SELECT *, upper(ls[i]) AS ln, (i - 1) * 2 AS p FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM il)),
po AS (SELECT *, max(CASE WHEN upper(pop_command) = 'CAPA' THEN frame_number END) OVER (PARTITION BY {_STREAM} ORDER BY frame_number) AS capa,
    max(CASE WHEN okp THEN frame_number END) OVER (PARTITION BY {_STREAM} ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastok
  FROM (SELECT *, (pop_response_indicator = '+OK' AND coalesce(pop_response_description, '') <> 'Begin TLS negotiation') AS okp, upper(coalesce(pop_command, '')) AS pc,
    coalesce(pop_response_description, '') AS pd FROM fd) z),
pl AS (SELECT *, coalesce(okp, false) AND (upper(pd) LIKE '%CAPABILITY LIST%' OR (capa IS NOT NULL AND (lastok IS NULL OR capa > lastok))) AS listing FROM po),
ev AS (
  SELECT {_EV}, 0 AS pos, 'greeting' AS kind, smtp_response_code AS detail {_SM} AND smtp_response_code = '220' AND upper(smtp_params_text) NOT LIKE '%READY TO START TLS%'
  UNION ALL SELECT {_EV}, 0, 'capability_response', '250 with ' || CAST({_NP} AS VARCHAR) || ' parameter(s)' {_SM} AND smtp_response_code = '250'
  UNION ALL SELECT {_EV}, 1, 'starttls_advertised', 'STARTTLS present in EHLO capabilities' {_SM} AND smtp_response_code = '250' AND smtp_params_text LIKE '%STARTTLS%'
  UNION ALL SELECT {_EV}, 0, 'starttls_accepted', '220 ready to start TLS' {_SM} AND smtp_response_code = '220' AND upper(smtp_params_text) LIKE '%READY TO START TLS%'
  UNION ALL SELECT {_EV}, 0, 'starttls_rejected', smtp_response_code || ' response' {_SM} AND smtp_response_code = '454'
  UNION ALL SELECT {_EV}, 2, 'capability_request', 'EHLO' {_SM} AND cmd LIKE 'EHLO%'
  UNION ALL SELECT {_EV}, 2, 'starttls_command', 'STARTTLS' {_SM} AND cmd LIKE 'STAR%'
  UNION ALL SELECT {_EV}, 2, 'auth_command', 'SMTP AUTH command observed' {_SM} AND cmd LIKE 'AUTH%'
  UNION ALL SELECT {_EV}, 2, 'plaintext_command', 'MAIL' {_SM} AND cmd LIKE 'MAIL%'
  UNION ALL SELECT {_EV}, CAST(p AS INT), 'capability_response', 'untagged CAPABILITY response' {_IM.replace('il', 'ill')} AND ln LIKE '*%' AND ln LIKE '%CAPABILITY%' AND ln NOT LIKE '%OK [%'
  UNION ALL SELECT {_EV}, CAST(p + 1 AS INT), 'starttls_advertised', 'STARTTLS in CAPABILITY list' {_IM.replace('il', 'ill')} AND ln LIKE '*%' AND ln LIKE '%CAPABILITY%' AND ln LIKE '%STARTTLS%'
  UNION ALL SELECT {_EV}, CAST(p AS INT), 'greeting', 'untagged greeting' {_IM.replace('il', 'ill')} AND ln LIKE '*%' AND NOT (ln LIKE '%CAPABILITY%' AND ln NOT LIKE '%OK [%')
  UNION ALL SELECT {_EV}, 1000000, 'capability_request', 'CAPABILITY' {_IM.replace('il', 'ix')} AND ic = 'CAPABILITY'
  UNION ALL SELECT {_EV}, 1000000, 'starttls_command', 'STARTTLS' {_IM.replace('il', 'ix')} AND ic = 'STARTTLS'
  UNION ALL SELECT {_EV}, 1000000, 'auth_command', 'IMAP ' || ic || ' observed' {_IM.replace('il', 'ix')} AND ic = 'LOGIN'
  UNION ALL SELECT {_EV}, 1000000, 'plaintext_command', ic {_IM.replace('il', 'ix')} AND ic = 'SELECT'
  UNION ALL SELECT {_EV}, 1000001, 'starttls_accepted', 'tagged ' || ist || ' for STARTTLS' {_IM.replace('il', 'ix')} AND ist <> '' AND (jn LIKE '%BEGIN TLS%' OR (jn LIKE '%STARTTLS%' AND ist = 'OK'))
  UNION ALL SELECT {_EV}, 1000001, 'starttls_rejected', 'tagged ' || ist || ' for STARTTLS' {_IM.replace('il', 'ix')} AND ist = 'NO' AND jn NOT LIKE '%BEGIN TLS%' AND jn LIKE '%STARTTLS%'
  UNION ALL SELECT {_EV}, 0, 'capability_request', 'CAPA' {_PO.replace('po ', 'pl ')} AND pc = 'CAPA'
  UNION ALL SELECT {_EV}, 0, 'starttls_command', 'STLS' {_PO.replace('po ', 'pl ')} AND pc = 'STLS'
  UNION ALL SELECT {_EV}, 0, 'auth_command', 'POP3 USER observed' {_PO.replace('po ', 'pl ')} AND pc = 'USER'
  UNION ALL SELECT {_EV}, 0, 'plaintext_command', 'LIST' {_PO.replace('po ', 'pl ')} AND pc = 'LIST'
  UNION ALL SELECT {_EV}, 1, 'starttls_accepted', '+OK begin TLS negotiation' {_PO.replace('po ', 'pl ')} AND pd = 'Begin TLS negotiation'
  UNION ALL SELECT {_EV}, 1, 'starttls_rejected', '-ERR not supported' {_PO.replace('po ', 'pl ')} AND pop_response_indicator = '-ERR'
  UNION ALL SELECT {_EV}, 1, 'capability_response', '+OK capability list' {_PO.replace('po ', 'pl ')} AND listing
  UNION ALL SELECT {_EV}, 1, 'greeting', '+OK greeting' {_PO.replace('po ', 'pl ')} AND coalesce(okp, false) AND NOT listing
  UNION ALL SELECT {_EV}, 2, 'starttls_advertised', 'STLS line in CAPA body' {_PO.replace('po ', 'pl ')} AND payload_text LIKE '%' || chr(10) || 'STLS' || chr(13) || '%'),
de AS (SELECT {_STREAM}, kind, direction, tcp_seq, detail, min({{'fn': frame_number, 'p': pos}}) AS f FROM ev GROUP BY ALL),
dd AS (SELECT {_STREAM}, kind, direction, tcp_seq, detail, f.fn AS frame_number, f.p AS pos FROM de)"""
EDGES = values("ed", "ek, ef, et", vocab.DIALOGUE_EDGES)
WALK = f"""{EDGES}, od AS (SELECT *, row_number() OVER (PARTITION BY {_STREAM} ORDER BY frame_number, pos, kind, detail) AS o FROM dd),
wk AS (SELECT {_STREAM}, o, frame_number, pos, kind, CAST('CONNECTED' AS VARCHAR) AS from_state, et AS to_state, coalesce(et, 'CONNECTED') AS cur FROM od
    LEFT JOIN ed ON ek = kind AND ef = 'CONNECTED' WHERE o = 1
  UNION ALL SELECT od.capture_id, od.tcp_stream_id, od.o, od.frame_number, od.pos, od.kind, wk.cur, e.et, coalesce(e.et, wk.cur) FROM wk
    JOIN od ON od.capture_id = wk.capture_id AND od.tcp_stream_id = wk.tcp_stream_id AND od.o = wk.o + 1 LEFT JOIN ed e ON e.ek = od.kind AND e.ef = wk.cur)"""
WIN = f"""ws AS (SELECT {_STREAM}, min(frame_number) AS window_start FROM fd WHERE NOT implicit AND protocol = 'smtp' AND (cmd LIKE 'EHLO%' OR cmd LIKE 'HELO%') GROUP BY 1, 2),
wn AS (SELECT ws.*, (SELECT min(frame_number) FROM fd WHERE fd.capture_id = ws.capture_id AND fd.tcp_stream_id = ws.tcp_stream_id AND frame_number > window_start
    AND regexp_matches(cmd, '^(STAR|AUTH|MAIL)')) AS window_end FROM ws)"""
#: the pieces of every stream joined as one text, cut into lines, and mapped back to frames
JOINED = f"""{WIN}, ck0 AS (SELECT {_STREAM}, tcp_seq, frame_number, payload_text, row_number() OVER (PARTITION BY {_STREAM}, tcp_seq ORDER BY frame_number) AS dup
    FROM fd JOIN wn USING (capture_id, tcp_stream_id) WHERE frame_number > window_start AND (window_end IS NULL OR frame_number < window_end)
    AND direction = 'SERVER_TO_CLIENT' AND coalesce(payload_text, '') <> ''),
ck1 AS (SELECT *, bool_or(tcp_seq IS NULL) OVER (PARTITION BY {_STREAM}) AS gap FROM ck0 WHERE tcp_seq IS NULL OR dup = 1),
ck AS (SELECT *, sum(length(payload_text)) OVER (PARTITION BY {_STREAM} ORDER BY CASE WHEN gap THEN frame_number ELSE tcp_seq END, frame_number) AS b1 FROM ck1),
tx AS (SELECT {_STREAM}, string_agg(payload_text, '' ORDER BY b1) AS body FROM ck GROUP BY 1, 2),
ln0 AS (SELECT {_STREAM}, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM tx),
ln AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY {_STREAM} ORDER BY i) AS e1 FROM ln0),
rj AS (SELECT DISTINCT ck.capture_id, ck.tcp_stream_id, frame_number FROM ln JOIN ck USING (capture_id, tcp_stream_id)
  WHERE regexp_matches(rtrim(l, chr(13)), '^250[- ]STARTTLS\\s*$') AND b1 - length(payload_text) < e1 AND b1 > e1 - length(l) - 1)"""


def directed(spark, sf):
    f = lifts.frames(spark, sf)
    return se.with_direction(f, se.stream_facts(f))


@query("stream_groups", f"WITH {FACTS} SELECT {_STREAM}, first_frame, last_frame, start_epoch, end_epoch, packet_count, capture_last_frame FROM sfx")
def stream_groups(spark, sf):
    return se.stream_groups(lifts.frames(spark, sf))


@query("resolve_roles", f"""WITH {FACTS} SELECT {_STREAM}, server_ip, server_port, client_ip, client_port, CASE WHEN greeted THEN 'observed service greeting/response'
  WHEN rl IS NOT NULL THEN 'well-known mail port ' || CAST(server_port AS VARCHAR) || ' (no greeting observed)' ELSE 'indeterminate: no greeting and no well-known port' END AS endpoint_basis FROM sfx""")
def resolve_roles(spark, sf):
    return se.stream_facts(lifts.frames(spark, sf)).select(*se.STREAM, "server_ip", "server_port", "client_ip", "client_port", "endpoint_basis")


@query("direction", f"WITH {FACTS} SELECT frame_number, direction FROM fd")
def direction(spark, sf):
    return directed(spark, sf).select("frame_number", "direction")


@query("transport_flags", f"WITH {FACTS} SELECT {_STREAM}, setup, teardown, reset FROM sfx")
def transport_flags(spark, sf):
    return se.stream_facts(lifts.frames(spark, sf)).select(*se.STREAM, "setup", "teardown", "reset")


@query("protocol_vote", f"WITH {FACTS} SELECT {_STREAM}, protocol FROM sfx")
def protocol_vote(spark, sf):
    return se.stream_facts(lifts.frames(spark, sf)).select(*se.STREAM, "protocol")


_ECOLS = ["capture_id", "tcp_stream_id", "frame_number", "direction", "tcp_seq", "pos", "kind", "detail"]


def _events_query(name, protocol):
    @query(name, f"WITH {EVENTS} SELECT {', '.join('ev.' + c for c in _ECOLS)} FROM ev JOIN sfx USING (capture_id, tcp_stream_id) WHERE protocol = '{protocol}'")
    def run(spark, sf):
        d = directed(spark, sf).filter((F.col("protocol") == protocol) & ~F.col("implicit"))
        return se.EXTRACTORS[protocol](d).select(*_ECOLS)


_events_query("smtp_events", "smtp")
_events_query("imap_events", "imap")
_events_query("pop3_events", "pop3")


@query("dedupe_events", f"WITH {EVENTS} SELECT {', '.join(_ECOLS)} FROM dd")
def dedupe_events(spark, sf):
    return se.dedupe_events(se.mail_events(directed(spark, sf))).select(*_ECOLS)


@query("walk_states", f"WITH RECURSIVE {EVENTS}, {WALK} SELECT {_STREAM}, frame_number, pos, kind, from_state, to_state FROM wk")
def walk_states(spark, sf):
    return se.walk_states(se.dedupe_events(se.mail_events(directed(spark, sf)))).select(
        *se.STREAM, "frame_number", "pos", "kind", "from_state", "to_state")


@query("capability_window", f"WITH {FACTS}, {WIN} SELECT * FROM wn")
def capability_window(spark, sf):
    return se.capability_window(directed(spark, sf))


@query("reassembled_advert", f"WITH {FACTS}, {JOINED} SELECT * FROM rj")
def reassembled_advert(spark, sf):
    return se.reassembled_advert(directed(spark, sf))


# ------------------------------------------------------------------------ reassembled texts
@query("reassembled_conversations", """WITH t AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY 1),
  l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line FROM t)
  SELECT conv_id, count(*) - 1 AS lines, count(CASE WHEN regexp_matches(line, '^250[- ]STARTTLS\\s*$') THEN 1 END) AS capability_lines FROM l GROUP BY 1""")
def reassembled_conversations(spark, sf):
    """Line counts of whole conversations from running totals over their turns."""
    lifts.register(spark, sf, "conversations")
    from wirepost.operators import skew
    c = spark.table("conversations").withColumn("_block", F.floor(F.col("turn") / 64))
    lines = F.size(F.split("text", "\n"))
    hits = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^250[- ]STARTTLS\s*$")))
    total = skew.running_total(c, ["conv_id"], "_block", ["turn"], lines, "upto")
    return total.groupBy("conv_id").agg(F.max("upto").alias("lines"), F.sum(hits).alias("capability_lines"))


# --------------------------------------------------------------------------- session evidence
_K = ["starttls_advertised", "capability_response", "starttls_command", "starttls_accepted", "starttls_rejected", "auth_command", "plaintext_command"]
EFACTS = "ef AS (SELECT capture_id, tcp_stream_id, count(*) AS n_events, count(DISTINCT kind) AS n_event_kinds, " + ", ".join(
    f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {k}_n, min(CASE WHEN kind = '{k}' THEN frame_number END) AS {k}_lo, max(CASE WHEN kind = '{k}' THEN frame_number END) AS {k}_hi" for k in _K) + \
    ", count(CASE WHEN direction = 'CLIENT_TO_SERVER' THEN 1 END) AS c2s, count(CASE WHEN direction = 'SERVER_TO_CLIENT' THEN 1 END) AS s2c FROM dd GROUP BY 1, 2)"
_VN = "CASE CASE WHEN {c} NOT LIKE '0x%' THEN try_cast({c} AS BIGINT) END " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in vocab.TLS_VERSIONS.items()) + " END"
SESS = f"""{EFACTS}, wa AS (SELECT {_STREAM}, count(*) AS wn, arg_max(to_state, o) AS ws, min(CASE WHEN kind = 'starttls_accepted' THEN frame_number END) AS acf FROM wk WHERE to_state IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT {_STREAM}, count(*) AS rn FROM rj GROUP BY 1, 2), {DIM_SUITE}, {DIM_GROUP},
s1 AS (SELECT sfx.*, (protocol IS NOT NULL AND implicit) AS implicit_tls, coalesce(n_events, 0) AS n_events, coalesce(n_event_kinds, 0) AS n_kinds, coalesce(c2s, 0) AS c2s, coalesce(s2c, 0) AS s2c,
    {', '.join(f'coalesce({k}_n, 0) AS {k}_n, {k}_lo, {k}_hi' for k in _K)},
    coalesce(wn, 0) AS wn, ws, acf, coalesce(rn, 0) AS rn, CASE WHEN protocol IS NULL THEN 'NONE' ELSE stream_tls END AS tls_state,
    CASE WHEN protocol IS NOT NULL AND setup AND (teardown OR reset) THEN 'COMPLETE' WHEN teardown OR reset THEN 'INCOMPLETE' WHEN last_frame >= capture_last_frame THEN 'TRUNCATED' ELSE 'INCOMPLETE' END AS completeness,
    {_VN.format(c='hello.sv')} AS vs, {_VN.format(c='hello.hv')} AS vh, CASE WHEN hello.cs NOT LIKE '0x%' THEN try_cast(hello.cs AS BIGINT) END AS cdec,
    CASE WHEN hello.cs = '0x1302' THEN 4866 ELSE try_cast(hello.cs AS INT) END AS ccode, CASE WHEN hello.ks = '0x0017' THEN 23 ELSE try_cast(hello.ks AS INT) END AS gcd
  FROM sfx LEFT JOIN ef USING (capture_id, tcp_stream_id) LEFT JOIN wa USING (capture_id, tcp_stream_id) LEFT JOIN ra USING (capture_id, tcp_stream_id)),
s2 AS (SELECT *, least(acf, CASE WHEN tls_state = 'ESTABLISHED' THEN tls_lo END) AS bnd, coalesce(vs, vh) AS ver,
    CASE WHEN tls_state = 'ESTABLISHED' THEN 'TLS_ESTABLISHED' WHEN tls_state = 'NONE' THEN coalesce(ws, 'CONNECTED') ELSE 'TLS_NEGOTIATING' END AS up,
    greatest(plaintext_command_hi, auth_command_hi, capability_response_hi) AS lastc FROM s1),
ss AS (SELECT *, CASE WHEN protocol IS NULL THEN 'CONNECTED' WHEN implicit_tls THEN 'IMPLICIT_TLS' WHEN completeness = 'COMPLETE' AND up <> 'TLS_ESTABLISHED' THEN 'CLOSED' ELSE up END AS app_state,
    CASE WHEN protocol IS NULL THEN 0 WHEN implicit_tls THEN 1 ELSE wn + CASE WHEN tls_state <> 'NONE' THEN 1 ELSE 0 END + CASE WHEN completeness = 'COMPLETE' AND up <> 'TLS_ESTABLISHED' THEN 1 ELSE 0 END END AS n_transitions,
    CASE WHEN protocol IS NULL THEN 'UNKNOWN' WHEN implicit_tls THEN 'NOT_OBSERVABLE' WHEN starttls_advertised_n > 0 OR rn > 0 THEN 'OBSERVED' WHEN capability_response_n > 0 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS adv_state,
    CASE WHEN implicit_tls THEN NULL WHEN starttls_advertised_n > 0 OR rn > 0 THEN 'true' WHEN capability_response_n > 0 THEN 'false' END AS adv_value,
    CASE WHEN protocol IS NULL THEN 'UNKNOWN' WHEN implicit_tls THEN 'NOT_OBSERVABLE' ELSE 'OBSERVED' END AS req_state,
    CASE WHEN protocol IS NULL OR implicit_tls THEN NULL WHEN starttls_command_n > 0 THEN 'true' ELSE 'false' END AS req_value,
    CASE WHEN protocol IS NULL OR implicit_tls THEN NULL WHEN auth_command_n > 0 THEN 'true' ELSE 'false' END AS auth_value,
    CASE WHEN protocol IS NULL THEN 'UNKNOWN' WHEN implicit_tls THEN 'NOT_OBSERVABLE' WHEN starttls_accepted_n > 0 AND starttls_rejected_n > 0 THEN 'AMBIGUOUS' WHEN starttls_accepted_n + starttls_rejected_n > 0 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS acc_state,
    CASE WHEN starttls_accepted_n > 0 AND starttls_rejected_n > 0 THEN NULL WHEN starttls_accepted_n > 0 THEN 'true' WHEN starttls_rejected_n > 0 THEN 'false' END AS acc_value,
    CASE WHEN protocol IS NULL THEN 'UNKNOWN' WHEN tls_state = 'ESTABLISHED' OR (NOT implicit_tls AND tls_state = 'NONE') THEN 'OBSERVED' ELSE 'AMBIGUOUS' END AS tt_state,
    CASE WHEN protocol IS NULL THEN NULL WHEN tls_state = 'ESTABLISHED' THEN 'true' WHEN NOT implicit_tls AND tls_state = 'NONE' THEN 'false' END AS tt_value,
    CASE WHEN hello IS NULL OR protocol IS NULL THEN 'UNKNOWN' WHEN ver IS NULL THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS ver_state,
    CASE WHEN hello IS NULL OR protocol IS NULL OR hello.cs IS NULL THEN 'UNKNOWN' WHEN cdec IS NULL THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS cip_state,
    CASE WHEN protocol IS NULL THEN NULL WHEN implicit_tls THEN 'false' WHEN bnd IS NULL THEN CASE WHEN plaintext_command_n + auth_command_n > 0 THEN 'true' ELSE 'false' END
      WHEN lastc > bnd THEN 'true' ELSE 'false' END AS pc_value FROM s2)"""
SESSIONS = f"WITH RECURSIVE {EVENTS}, {WALK}, {JOINED}, {SESS}"


def rebuilt(spark, sf):
    return se.reconstruct_sessions(spark, lifts.frames(spark, sf))


def _field(name, field, value, state):
    @query(name, f"{SESSIONS} SELECT {_STREAM}, {value} AS value, {state} AS state FROM ss")
    def run(spark, sf):
        return rebuilt(spark, sf).select(*se.STREAM, F.col(f"{field}.value"), F.col(f"{field}.state"))


_field("advert_evidence", "starttls_advertised", "adv_value", "adv_state")
_field("bool_evidence", "starttls_requested", "req_value", "req_state")
_field("auth_evidence", "auth_activity", "auth_value", "req_state")
_field("acceptance_evidence", "starttls_accepted", "CASE WHEN protocol IS NOT NULL AND NOT implicit_tls THEN acc_value END", "acc_state")
_field("negotiated_version", "tls_negotiated_version", "CASE WHEN protocol IS NOT NULL THEN ver END", "ver_state")
_field("negotiated_cipher", "tls_cipher_suite", "CASE WHEN protocol IS NOT NULL THEN printf('0x%04x', cdec) END", "cip_state")
_field("tls_transition", "tls_transition", "tt_value", "tt_state")
_field("plaintext_after", "plaintext_continuation", "pc_value", "CASE WHEN protocol IS NULL THEN 'UNKNOWN' ELSE 'OBSERVED' END")


@query("classify_tls", f"WITH {FACTS} SELECT {_STREAM}, stream_tls AS tls_state, tls_n, tls_lo, tls_hi FROM sfx")
def classify_tls(spark, sf):
    return se.stream_facts(lifts.frames(spark, sf)).select(
        *se.STREAM, F.col("stream_tls").alias("tls_state"), "tls_n", "tls_lo", "tls_hi")


@query("completeness", f"{SESSIONS} SELECT {_STREAM}, completeness, app_state, n_transitions FROM ss")
def completeness(spark, sf):
    return rebuilt(spark, sf).select(*se.STREAM, "completeness", "app_state", "n_transitions")


@query("transport_only", f"{SESSIONS} SELECT {_STREAM}, tls_state, completeness, packet_count FROM ss WHERE protocol IS NULL")
def transport_only(spark, sf):
    return rebuilt(spark, sf).filter(F.col("protocol").isNull()).select(*se.STREAM, "tls_state", "completeness", "packet_count")


@query("reconstruct_sessions", f"""{SESSIONS} SELECT {_STREAM}, protocol, client_ip, server_ip, server_port, first_frame, last_frame, packet_count, completeness, app_state, tls_state,
  implicit_tls, adv_value, adv_state, req_value, acc_state, tt_value, CASE WHEN protocol IS NOT NULL THEN ver END AS version, pc_value, auth_value, n_events, n_kinds AS n_event_kinds, n_transitions,
  c2s AS c2s_events, s2c AS s2c_events, CASE WHEN ver = 'TLS1.3' AND protocol IS NOT NULL THEN CASE WHEN group_name IS NOT NULL THEN 'ECDHE (' || group_name || ')' ELSE 'ephemeral (EC)DHE' END
    WHEN protocol IS NOT NULL THEN kex END AS kex FROM ss LEFT JOIN dim_suite ON ccode = code LEFT JOIN dim_group ON gcd = gcode""")
def reconstruct_sessions(spark, sf):
    return rebuilt(spark, sf).select(
        *se.STREAM, "protocol", "client_ip", "server_ip", "server_port", "first_frame", "last_frame", "packet_count",
        "completeness", "app_state", "tls_state", "implicit_tls", F.col("starttls_advertised.value").alias("adv_value"),
        F.col("starttls_advertised.state").alias("adv_state"), F.col("starttls_requested.value").alias("req_value"),
        F.col("starttls_accepted.state").alias("acc_state"), F.col("tls_transition.value").alias("tt_value"),
        F.col("tls_negotiated_version.value").alias("version"), F.col("plaintext_continuation.value").alias("pc_value"),
        F.col("auth_activity.value").alias("auth_value"), "n_events", "n_event_kinds", "n_transitions", "c2s_events",
        "s2c_events", F.col("tls_key_exchange.value").alias("kex"))


_CL = "kind IN ('plaintext_command', 'auth_command')"
_AT = "SELECT capture_id, tcp_stream_id, frame_number, {f} AS field, {r} AS role FROM dd JOIN ss USING (capture_id, tcp_stream_id) WHERE "
_HF = "SELECT capture_id, tcp_stream_id, hello.fn, '{f}', 'server hello' FROM ss WHERE protocol IS NOT NULL AND hello IS NOT NULL"
_IS13 = "coalesce(ver = 'TLS1.3', false)"
PROVENANCE = f"""xf AS (SELECT capture_id, tcp_stream_id, min(frame_number) AS xfn FROM fr WHERE cert_serial IS NOT NULL GROUP BY 1, 2),
pv0 AS ({_AT.format(f="'starttls_advertised'", r="'capability'")} kind = 'starttls_advertised'
  UNION {_AT.format(f="'starttls_advertised'", r="'capability reply'")} kind = 'capability_response' AND starttls_advertised_n = 0 AND rn = 0
  UNION {_AT.format(f="'starttls_requested'", r="'upgrade command'")} kind = 'starttls_command'
  UNION {_AT.format(f="'starttls_accepted'", r="'acceptance'")} kind = 'starttls_accepted'
  UNION {_AT.format(f="'starttls_accepted'", r="'rejection'")} kind = 'starttls_rejected'
  UNION {_AT.format(f="'auth_activity'", r="'authentication'")} kind = 'auth_command'
  UNION {_AT.format(f="'plaintext_continuation'", r="'cleartext'")} bnd IS NULL AND {_CL}
  UNION {_AT.format(f="'plaintext_continuation'", r="'cleartext after upgrade'")} frame_number > bnd AND ({_CL} OR kind = 'capability_response')
  UNION SELECT capture_id, tcp_stream_id, rj.frame_number, 'starttls_advertised', 'rejoined line' FROM rj JOIN ss USING (capture_id, tcp_stream_id) WHERE starttls_advertised_n = 0
  UNION SELECT capture_id, tcp_stream_id, fr.frame_number, 'tls_transition', 'tls record' FROM fr JOIN ss USING (capture_id, tcp_stream_id) WHERE fr.tls_present AND ss.protocol IS NOT NULL
  UNION {_HF.format(f='tls_negotiated_version')} UNION {_HF.format(f='tls_cipher_suite')} AND hello.cs IS NOT NULL
  UNION {_HF.format(f='tls_cipher_suite_name')} AND ccode IS NOT NULL UNION {_HF.format(f='tls_key_exchange')} AND ({_IS13} OR ccode IS NOT NULL)
  UNION {_HF.format(f='tls_named_group')} AND gcd IS NOT NULL UNION {_HF.format(f='tls_forward_secrecy')} AND ({_IS13} OR ccode IS NOT NULL)
  UNION SELECT capture_id, tcp_stream_id, xfn, 'tls_certificate_chain', 'certificate' FROM xf JOIN ss USING (capture_id, tcp_stream_id) WHERE protocol IS NOT NULL),
pv AS (SELECT capture_id, tcp_stream_id, field, frame_number, min(role) AS role FROM pv0 GROUP BY 1, 2, 3, 4)"""
#: the steps of the walk, then those of TLS and of the close
TRANSITIONS = f"""tr0 AS (SELECT {_STREAM}, 0 AS phase, kind AS event, from_state, to_state, frame_number AS frame_lo, frame_number AS frame_hi, 1 AS frame_n, pos, o FROM wk WHERE to_state IS NOT NULL
  UNION ALL SELECT {_STREAM}, 1, 'implicit_tls', 'CONNECTED', 'IMPLICIT_TLS', tls_lo, tls_hi, tls_n, 0, 0 FROM ss WHERE implicit_tls
  UNION ALL SELECT {_STREAM}, 1, CASE WHEN tls_state = 'ESTABLISHED' THEN 'tls_established' ELSE 'tls_negotiation_observed' END, coalesce(ws, 'CONNECTED'), up, tls_lo, tls_hi, tls_n, 0, 0
    FROM ss WHERE protocol IS NOT NULL AND NOT implicit_tls AND tls_state <> 'NONE'
  UNION ALL SELECT {_STREAM}, 2, 'connection_closed', up, 'CLOSED', last_frame, last_frame, 1, 0, 0 FROM ss WHERE app_state = 'CLOSED'),
tr AS (SELECT *, row_number() OVER (PARTITION BY {_STREAM} ORDER BY phase, frame_lo, pos, o) AS step FROM tr0)"""


def parts(spark, sf):
    return se.rebuild(lifts.frames(spark, sf))


@query("evidence_frames", f"{SESSIONS}, {PROVENANCE} SELECT * FROM pv")
def evidence_frames(spark, sf):
    return se.evidence_frames(spark, parts(spark, sf))


_PER_FIELD = ", ".join(f"count(CASE WHEN field = '{f}' THEN 1 END) AS {f}" for f in vocab.EVIDENCE_FIELDS)


@query("evidence_counts", f"""{SESSIONS}, {PROVENANCE}, n AS (SELECT {_STREAM}, {_PER_FIELD}, sum(frame_number) AS total FROM pv GROUP BY 1, 2)
  SELECT {_STREAM}, {', '.join(f'coalesce({f}, 0) AS {f}' for f in vocab.EVIDENCE_FIELDS)} FROM ss LEFT JOIN n USING (capture_id, tcp_stream_id)""")
def evidence_counts(spark, sf):
    """Frames behind each of the thirteen fields, as the session rows tell them."""
    return rebuilt(spark, sf).select(*se.STREAM, *[F.col(f"{f}.frame_n").alias(f) for f in vocab.EVIDENCE_FIELDS])


@query("session_transitions", f"{SESSIONS}, {TRANSITIONS} SELECT {_STREAM}, step, event, from_state, to_state, frame_lo, frame_hi, frame_n FROM tr")
def session_transitions(spark, sf):
    return se.session_transitions(spark, parts(spark, sf)).drop("timestamp_epoch", "evidence_state", "basis")


@query("session_notes", f"""{SESSIONS} SELECT {_STREAM}, frame_number, 'out of order: ' || kind || ' in state ' || from_state AS note FROM wk WHERE to_state IS NULL
  UNION ALL SELECT {_STREAM}, last_frame, 'boundaries incomplete: setup ' || CASE WHEN setup THEN 'yes' ELSE 'no' END || ', teardown ' || CASE WHEN teardown OR reset THEN 'yes' ELSE 'no' END
    || CASE WHEN completeness = 'TRUNCATED' THEN ', capture ends while open' ELSE ', capture goes on' END FROM ss WHERE protocol IS NOT NULL AND NOT (setup AND (teardown OR reset))""")
def session_notes(spark, sf):
    return se.session_notes(spark, parts(spark, sf))


@query("timeline", f"""{SESSIONS}, {PROVENANCE}, {TRANSITIONS}, tm AS (SELECT {_STREAM}, frame_lo AS frame_number, title, time FROM (
    SELECT tr.capture_id, tr.tcp_stream_id, frame_lo, event AS title, CASE WHEN phase = 0 THEN timestamp_epoch END AS time FROM tr LEFT JOIN fr ON phase = 0 AND fr.frame_number = frame_lo) q),
  tn AS (SELECT {_STREAM}, frame_number, min(time) AS time FROM tm GROUP BY 1, 2, 3)
  SELECT dd.capture_id, dd.tcp_stream_id, dd.frame_number, kind AS title, round(time, 3) AS time, 'event' AS step FROM dd LEFT JOIN tn USING (capture_id, tcp_stream_id, frame_number)
  UNION ALL SELECT {_STREAM}, frame_number, field, NULL, 'evidence' FROM pv
  UNION ALL SELECT {_STREAM}, frame_number, title, round(time, 3), 'transition' FROM tm WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.capture_id = tm.capture_id AND dd.tcp_stream_id = tm.tcp_stream_id AND dd.frame_number = tm.frame_number)""")
def timeline(spark, sf):
    """Events, evidence and state changes of every rebuilt session."""
    rows = marts.timeline(*se.timeline_parts(spark, parts(spark, sf)))
    return rows.select(*se.STREAM, "frame_number", "title", F.round("time", 3).alias("time"), "step")
