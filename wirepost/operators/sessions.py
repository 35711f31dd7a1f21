"""Frames to sessions: grouping, roles, dialogue events, state walk, TLS facts.

A stream is one (capture_id, tcp_stream_id).  Per-stream facts are plain mergeable aggregates.
The two order-dependent steps, the dialogue walk and the payload reassembly, cut a stream into
frame ranges so that one endless stream does not become one endless task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev
from wirepost.operators import crypto, skew
from wirepost.plans import lineage

STREAM = ["capture_id", "tcp_stream_id"]
#: characters that end a line besides a carriage return: line feed, vertical tab, form feed, next
#: line, line and paragraph separator
LINE_MARK = "[\n\x0b\x0c\x85\u2028\u2029]"
LINE_END = f"\r\n|\r|{LINE_MARK}"
FRAME_RANGE = 1024
#: frame ranges of a section of the dialogue walk
SECTION = 1024
PORTS = list(vocab.MAIL_PORTS)


# ------------------------------------------------------------------ streams, roles, transport
def is_greeting() -> Column:
    """Frames only a server sends."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (filled("mail.smtp_response_code") | filled("mail.pop_response_indicator")
            | filled("mail.imap_response_status")
            | F.exists("mail.imap_lines", lambda x: F.ltrim(x).startswith("*")))


def _role_columns() -> dict[str, Column]:
    seen = is_greeting() & (F.coalesce("src_ip", F.lit("")) != "") & F.col("src_port").isNotNull()
    from_src, from_dst = casts.int_set(F.col("src_port"), PORTS), casts.int_set(F.col("dst_port"), PORTS)
    end = lambda s, d: F.struct(F.col(f"{s}_ip").alias("server_ip"), F.col(f"{s}_port").alias("server_port"),
                                F.col(f"{d}_ip").alias("client_ip"), F.col(f"{d}_port").alias("client_port"))
    by_port = F.when(from_src, end("src", "dst")).otherwise(end("dst", "src"))
    return {"_greeted": F.min_by(end("src", "dst"), F.when(seen, F.col("frame_number"))),
            "_ported": F.min_by(by_port, F.when(from_src | from_dst, F.col("frame_number")))}


def flag_value() -> Column:
    return casts.to_int(F.col("tcp_flags"))


def _bit(mask: int) -> Column:
    return F.coalesce(flag_value().bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def _transport_columns() -> dict[str, Column]:
    syn, ack = _bit(0x02), _bit(0x10)
    return {"_syn": F.bool_or(syn & ~ack), "_synack": F.bool_or(syn & ack),
            "teardown": F.bool_or(_bit(0x01)), "reset": F.bool_or(_bit(0x04))}


def _vote_columns() -> dict[str, Column]:
    out = {}
    for p in ("smtp", "imap", "pop3"):
        mine = F.col("app_protocol") == p
        out[f"_n_{p}"] = F.count_if(mine)
        out[f"_f_{p}"] = F.min(F.when(mine, F.col("frame_number")))
    return out


def _vote() -> Column:
    """Most frames wins, the protocol seen first on a tie; else the server port decides."""
    best = F.array_max(F.array(*[
        F.when(F.col(f"_n_{p}") > 0, F.struct(
            F.col(f"_n_{p}").alias("n"), (-F.coalesce(f"_f_{p}", F.lit(0))).alias("f"),
            F.lit(p).alias("p"))) for p in ("smtp", "imap", "pop3")]))["p"]
    by_port = casts.lookup({str(k): v[0] for k, v in vocab.MAIL_PORTS.items()},
                           F.col("server_port").cast("string"), F.lit(None).cast("string"))
    return F.coalesce(best, by_port)


def _tls_columns() -> dict[str, Column]:
    present, kind = F.col("tls.present"), F.col("tls.handshake_type")
    n = F.when(present, F.col("frame_number"))
    hello = F.struct(F.col("tls.supported_version").alias("supported"),
                     F.col("tls.handshake_version").alias("version"),
                     F.col("tls.cipher_suite").alias("suite"),
                     F.col("tls.key_share_group").alias("share"), F.col("frame_number").alias("frame"))
    # the first message that carries a certificate, as its own bounded row
    return {"_ch": F.bool_or(present & (F.coalesce(kind, F.lit(0)) == 1)),
            "_sh": F.bool_or(present & (F.coalesce(kind, F.lit(0)) == 2)),
            "_app": F.bool_or(present & F.coalesce("tls.has_app_data", F.lit(False))),
            "tls_lo": F.min(n), "tls_hi": F.max(n), "tls_n": F.count(n),
            "hello": F.min_by(hello, F.when(kind == 2, F.col("frame_number"))),
            "x509": F.min_by("tls.x509", F.when(F.col("tls.x509").isNotNull(),
                                                F.col("frame_number"))),
            "x509_frame": F.min(F.when(F.col("tls.x509").isNotNull(), F.col("frame_number")))}


def tls_state() -> Column:
    return (F.when(F.col("tls_n") == 0, "NONE")
            .when(F.col("_ch") & F.col("_sh") & F.col("_app"), "ESTABLISHED")
            .when(F.col("_ch") & F.col("_sh"), "SERVER_HELLO_OBSERVED")
            .when(F.col("_ch"), "CLIENT_HELLO_OBSERVED").otherwise("HANDSHAKE_INTERRUPTED"))


def stream_facts(frames: DataFrame) -> DataFrame:
    """Everything about a stream that does not depend on the order of its events, in one pass."""
    n = F.col("frame_number")
    grouped = frames.groupBy(*STREAM).agg(
        F.min(n).alias("first_frame"), F.max(n).alias("last_frame"),
        F.min_by("timestamp_epoch", n).alias("start_epoch"),
        F.max_by("timestamp_epoch", n).alias("end_epoch"),
        F.count(F.lit(1)).alias("packet_count"), F.bool_or("implicit_tls_port").alias("implicit"),
        *[c.alias(k) for group in (_role_columns(), _transport_columns(), _vote_columns(),
                                   _tls_columns()) for k, c in group.items()])
    role = F.coalesce("_greeted", "_ported")
    basis = (F.when(F.col("_greeted").isNotNull(), "observed service greeting/response")
             .when(F.col("_ported").isNotNull(), F.format_string(
                 "well-known mail port %d (no greeting observed)", F.col("_ported.server_port")))
             .otherwise("indeterminate: no greeting and no well-known port"))
    with_roles = grouped.withColumns({
        **{c: role[c] for c in ("server_ip", "server_port", "client_ip", "client_port")},
        "endpoint_basis": basis, "setup": F.col("_syn") & F.col("_synack"), "stream_tls": tls_state()})
    last = with_roles.groupBy("capture_id").agg(F.max("last_frame").alias("capture_last_frame"))
    return with_roles.withColumn("protocol", _vote()).join(last, "capture_id") \
        .drop("_greeted", "_ported", "_syn", "_synack", "_ch", "_sh", "_app",
              *[f"_{k}_{p}" for k in "nf" for p in ("smtp", "imap", "pop3")])


def stream_groups(frames: DataFrame) -> DataFrame:
    return stream_facts(frames).select(*STREAM, "first_frame", "last_frame", "start_epoch",
                                       "end_epoch", "packet_count", "capture_last_frame")


def with_direction(frames: DataFrame, facts: DataFrame) -> DataFrame:
    """Direction of each frame, seen from the resolved server."""
    slim = facts.select(*STREAM, "server_ip", "server_port", "protocol", "implicit")
    sip, sport = F.col("server_ip"), F.col("server_port")
    direction = (F.when((F.col("src_ip") == sip) & (F.col("src_port") == sport), "SERVER_TO_CLIENT")
                 .when((F.col("dst_ip") == sip) & (F.col("dst_port") == sport), "CLIENT_TO_SERVER")
                 .otherwise("UNKNOWN"))
    return frames.join(slim, STREAM).withColumn("direction", direction)


# --------------------------------------------------------------------------------- dialogue
def command_text() -> Column:
    """The full SMTP command line, else the truncated command."""
    m = F.col("mail")
    line = F.when(F.coalesce(m["smtp_command_line"], F.lit("")) != "", m["smtp_command_line"])
    return F.upper(F.trim(F.coalesce(line, F.when(m["smtp_command"] != "", m["smtp_command"]))))


def _starts(text: Column, words) -> Column:
    return F.coalesce(text.rlike("^(" + "|".join(words) + ")"), F.lit(False))


def _event(kind: str, pos: int, condition: Column, detail) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(
        F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("detail")))


def _explode_events(frames: DataFrame, events: list[Column]) -> DataFrame:
    return frames.select(*STREAM, "frame_number", "timestamp_epoch", "direction", "tcp_seq",
                         F.inline(F.array_compact(F.array(*events))))


def smtp_events(frames: DataFrame) -> DataFrame:
    m, cmd = F.col("mail"), command_text()
    code, params = F.coalesce(m["smtp_response_code"], F.lit("")), m["smtp_response_params"]
    says = lambda word: F.exists(params, lambda p: F.upper(p).contains(word))
    ready, is220, is250 = says("READY TO START TLS"), code.startswith("220"), code.startswith("250")
    word = F.element_at(F.split(cmd, r"\s+"), 1)
    hello, start = _starts(cmd, ["EHLO", "HELO"]), _starts(cmd, ["STAR"])
    auth = _starts(cmd, ["AUTH"])
    return _explode_events(frames, [
        _event("greeting", 0, is220 & ~ready, code),
        _event("capability_response", 0, is250, F.format_string("250 with %d parameter(s)", F.size(params))),
        _event("starttls_advertised", 1, is250 & says("STARTTLS"), "STARTTLS present in EHLO capabilities"),
        _event("starttls_accepted", 0, is220 & ready, "220 ready to start TLS"),
        _event("starttls_rejected", 0, code.startswith("4") | code.startswith("5"),
               F.concat(code, F.lit(" response"))),
        _event("capability_request", 2, hello, word),
        _event("starttls_command", 2, start, "STARTTLS"),
        _event("auth_command", 2, auth, "SMTP AUTH command observed"),
        _event("plaintext_command", 2, _starts(cmd, vocab.SMTP_PLAINTEXT), word)])


def imap_events(frames: DataFrame) -> DataFrame:
    m = F.col("mail")
    lines = F.filter(F.transform(m["imap_lines"], lambda x: F.trim(x)), lambda x: x != "")
    cmd = F.upper(F.trim(F.coalesce(m["imap_command"], F.lit(""))))
    status = F.upper(F.trim(F.coalesce(m["imap_response_status"], F.lit(""))))
    joined = F.upper(F.array_join(lines, " "))

    def of_line(line: Column, i: Column) -> Column:
        up = F.upper(line)
        cap = up.contains("CAPABILITY") & ~up.contains("OK [")
        pos = (i * 2).cast("int")
        make = lambda k, d, p: F.struct(p.alias("pos"), F.lit(k).alias("kind"), F.lit(d).alias("detail"))
        return F.when(up.startswith("*"), F.array_compact(F.array(
            F.when(cap, make("capability_response", "untagged CAPABILITY response", pos)),
            F.when(cap & up.contains("STARTTLS"), make("starttls_advertised", "STARTTLS in CAPABILITY list", pos + 1)),
            F.when(~cap, make("greeting", "untagged greeting", pos))))) \
            .otherwise(F.array().cast("array<struct<pos:int,kind:string,detail:string>>"))

    base = 1_000_000      # after every line of the frame
    accepted = (status != "") & (joined.contains("BEGIN TLS") | (joined.contains("STARTTLS") & (status == "OK")))
    singles = F.array_compact(F.array(
        _event("capability_request", base, cmd == "CAPABILITY", "CAPABILITY"),
        _event("starttls_command", base, cmd == "STARTTLS", "STARTTLS"),
        _event("auth_command", base, cmd.isin("LOGIN", "AUTHENTICATE"),
               F.concat(F.lit("IMAP "), cmd, F.lit(" observed"))),
        _event("plaintext_command", base, cmd.isin(vocab.IMAP_PLAINTEXT), cmd),
        _event("starttls_accepted", base + 1, accepted, F.concat(F.lit("tagged "), status, F.lit(" for STARTTLS"))),
        _event("starttls_rejected", base + 1, ~accepted & status.isin("NO", "BAD") & joined.contains("STARTTLS"),
               F.concat(F.lit("tagged "), status, F.lit(" for STARTTLS")))))
    every = F.concat(F.flatten(F.transform(lines, of_line)), singles)
    return frames.select(*STREAM, "frame_number", "timestamp_epoch", "direction", "tcp_seq",
                         F.inline(every))


def pop3_events(frames: DataFrame) -> DataFrame:
    """A plain +OK answers a pending CAPA when one was sent after the previous plain +OK."""
    m = F.col("mail")
    cmd = F.upper(F.trim(F.coalesce(m["pop_command"], F.lit(""))))
    ind = F.trim(F.coalesce(m["pop_response_indicator"], F.lit("")))
    desc = F.trim(F.coalesce(m["pop_response_description"], F.lit("")))
    begin = F.upper(desc).contains("BEGIN TLS")
    plain_ok = (ind != "") & ~begin & ~ind.startswith("-ERR")
    marked = frames.filter((cmd != "") | (ind != "") | F.col("payload_text").isNotNull()) \
        .withColumn("_block", F.floor(F.coalesce("frame_number", F.lit(0)) / (FRAME_RANGE * 64)))
    n = F.col("frame_number")
    marked = skew.running_max(marked, STREAM, "_block", ["frame_number"], F.when(cmd == "CAPA", n), "_capa")
    marked = skew.running_max(marked, STREAM, "_block", ["frame_number"], F.when(plain_ok, n), "_ok", before=True)
    pending = F.col("_capa").isNotNull() & (F.col("_ok").isNull() | (F.col("_capa") > F.col("_ok")))
    listing = plain_ok & (F.upper(desc).contains("CAPABILITY LIST") | pending)
    stls = F.exists(F.split("payload_text", LINE_END), lambda x: F.upper(F.trim(x)) == "STLS")
    return _explode_events(marked, [
        _event("capability_request", 0, cmd == "CAPA", "CAPA"),
        _event("starttls_command", 0, cmd == "STLS", "STLS"),
        _event("auth_command", 0, cmd.isin("USER", "PASS", "APOP"),
               F.concat(F.lit("POP3 "), cmd, F.lit(" observed"))),
        _event("plaintext_command", 0, cmd.isin(vocab.POP3_PLAINTEXT), cmd),
        _event("starttls_accepted", 1, (ind != "") & begin, "+OK begin TLS negotiation"),
        _event("starttls_rejected", 1, ~begin & ind.startswith("-ERR"),
               F.concat(F.lit("-ERR "), desc)),
        _event("capability_response", 1, listing, "+OK capability list"),
        _event("greeting", 1, plain_ok & ~listing, "+OK greeting"),
        _event("starttls_advertised", 2, stls, "STLS line in CAPA body")])


EXTRACTORS = {"smtp": smtp_events, "imap": imap_events, "pop3": pop3_events}


def mail_events(directed: DataFrame) -> DataFrame:
    """Dialogue events of all explicit-TLS mail streams, each read by its own grammar."""
    open_frames = directed.filter(~F.col("implicit"))
    out = None
    for protocol, extract in EXTRACTORS.items():
        one = extract(open_frames.filter(F.col("protocol") == protocol))
        out = one if out is None else out.unionByName(one)
    return out


def dedupe_events(events: DataFrame) -> DataFrame:
    """Retransmissions repeat kind, direction, sequence number and detail; the first one stays."""
    return events.groupBy(*STREAM, "kind", "direction", "tcp_seq", "detail").agg(
        F.min(F.struct("frame_number", "pos", "timestamp_epoch")).alias("f")) \
        .select(*STREAM, "kind", "direction", "tcp_seq", "detail", "f.*")


# ------------------------------------------------------------------------------- state walk
WALK_STATES = vocab.APP_STATES[:8] + ["PLAINTEXT_CONTINUATION"]


def _edges() -> Column:
    index = {s: i for i, s in enumerate(WALK_STATES)}
    return F.create_map(*[x for kind, a, b in vocab.DIALOGUE_EDGES
                          for x in (F.lit(f"{kind}|{index[a]}"), F.lit(index[b]))])


def walk_states(events: DataFrame) -> DataFrame:
    """Every event with the state before it and the state it led to (null when ignored).

    A frame range is folded once from every possible state, which turns it into a small lookup
    vector.  Vectors compose: those of a thousand ranges make the vector of a section, the sections
    before one give its starting state, the ranges before one inside its section that of the range,
    and one more fold inside the range replays the events.  So no list is longer than a section,
    but that of a stream's sections, each about a million frames.
    """
    edges = _edges()
    row = F.struct("frame_number", "pos", "kind", "detail", "timestamp_epoch")
    ranges = events.withColumn("_range", F.floor(F.coalesce("frame_number", F.lit(0)) / FRAME_RANGE)) \
        .groupBy(*STREAM, "_range").agg(F.array_sort(F.collect_list(row)).alias("_ev"))

    def step(state: Column, e: Column) -> Column:
        return F.coalesce(edges[F.concat(e["kind"], F.lit("|"), state.cast("string"))], state)

    starts = F.array(*[F.lit(i) for i in range(len(WALK_STATES))])
    ranges = ranges.withColumns({"_vector": F.transform(starts, lambda s: F.aggregate("_ev", s, step)),
                                 "_section": F.floor(F.col("_range") / SECTION)})
    earlier = lambda key, by: W.partitionBy(*key).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    follow = lambda vectors, start: F.aggregate(vectors, start, lambda s, v: F.get(v, s))
    sections = ranges.groupBy(*STREAM, "_section").agg(F.array_sort(F.collect_list(F.struct("_range", "_vector"))).alias("_parts")) \
        .withColumn("_whole", F.transform(starts, lambda s: F.aggregate("_parts", s, lambda a, p: F.get(p["_vector"], a)))) \
        .withColumn("_before", F.collect_list("_whole").over(earlier(STREAM, "_section"))) \
        .select(*STREAM, "_section", follow("_before", F.lit(0)).alias("_entry"))
    placed = ranges.join(sections, [*STREAM, "_section"]) \
        .withColumn("_prior", F.collect_list("_vector").over(earlier([*STREAM, "_section"], "_range"))) \
        .withColumn("_start", follow("_prior", F.col("_entry")))

    def replay(acc: Column, e: Column) -> Column:
        key = F.concat(e["kind"], F.lit("|"), acc["state"].cast("string"))
        to = F.coalesce(edges[key], F.lit(-1))
        done = F.struct(e["frame_number"].alias("frame_number"), e["pos"].alias("pos"),
                        e["kind"].alias("kind"), e["detail"].alias("detail"),
                        e["timestamp_epoch"].alias("timestamp_epoch"),
                        acc["state"].alias("from"), to.alias("to"))
        return F.struct(F.when(to >= 0, to).otherwise(acc["state"]).alias("state"),
                        F.concat(acc["steps"], F.array(done)).alias("steps"))

    empty = F.array().cast("array<struct<frame_number:bigint,pos:int,kind:string,detail:string,"
                           "timestamp_epoch:double,from:int,to:int>>")
    walked = placed.withColumn("_w", F.aggregate(
        "_ev", F.struct(F.col("_start").alias("state"), empty.alias("steps")), replay))
    names = F.array(*[F.lit(s) for s in WALK_STATES])
    name = lambda c: F.when(c >= 0, F.get(names, c))
    return walked.select(*STREAM, F.explode("_w.steps").alias("s")).select(
        *STREAM, "s.frame_number", "s.pos", "s.kind", "s.detail", "s.timestamp_epoch",
        name(F.col("s.from")).alias("from_state"), name(F.col("s.to")).alias("to_state"))


# ------------------------------------------------------------------------------ reassembly
def capability_window(directed: DataFrame) -> DataFrame:
    """Frames between an SMTP hello and the next command that ends the capability phase."""
    smtp = directed.filter((F.col("protocol") == "smtp") & ~F.col("implicit"))
    cmds = smtp.select(*STREAM, "frame_number", command_text().alias("_cmd")).filter("_cmd IS NOT NULL")
    start = cmds.filter(_starts(F.col("_cmd"), ["EHLO", "HELO"])).groupBy(*STREAM) \
        .agg(F.min("frame_number").alias("window_start"))
    ends = cmds.filter(_starts(F.col("_cmd"), vocab.SMTP_PHASE_ENDING)).join(start, STREAM) \
        .filter(F.col("frame_number") > F.col("window_start")).groupBy(*STREAM) \
        .agg(F.min("frame_number").alias("window_end"))
    return start.join(ends, STREAM, "left")


def reassembled_advert(directed: DataFrame) -> DataFrame:
    """Frames that carry a STARTTLS capability line once the server's segments are rejoined.

    Segments are put in sequence order and cut at line ends; a running count of the line ends
    before a segment numbers its pieces, so a line that crosses segments is simply the group of
    pieces with one number.  No stream is ever concatenated as a whole.
    """
    window = capability_window(directed)
    inside = directed.join(window, STREAM).filter(
        (F.col("frame_number") > F.col("window_start"))
        & (F.col("window_end").isNull() | (F.col("frame_number") < F.col("window_end")))
        & (F.col("direction") == "SERVER_TO_CLIENT")
        & (F.coalesce("payload_text", F.lit("")) != ""))
    seq = F.col("tcp_seq")
    with_seq = inside.filter(seq.isNotNull()).groupBy(*STREAM, "tcp_seq").agg(
        F.min(F.struct("frame_number", "payload_text")).alias("f")) \
        .select(*STREAM, "tcp_seq", "f.*")
    chunks = with_seq.unionByName(inside.filter(seq.isNull()).select(
        *STREAM, "tcp_seq", "frame_number", "payload_text"))
    unsequenced = chunks.groupBy(*STREAM).agg(F.bool_or(seq.isNull()).alias("_gap"))
    ordered = chunks.join(unsequenced, STREAM).withColumn(
        "_at", F.when(F.col("_gap"), F.col("frame_number")).otherwise(seq))
    ordered = ordered.withColumn("_block", F.floor(F.col("_at") / (1 << 20)))
    # a carriage return and its line feed may arrive in different segments
    pieces = F.split("payload_text", f"(?<={LINE_MARK})|(?<=\r)(?!\n)")
    ends = F.size(F.filter(pieces, lambda p: p.rlike(f"({LINE_MARK}|\r)$")))
    counted = skew.running_total(ordered, STREAM, "_block", ["_at", "frame_number"], ends, "_upto")
    rows = counted.select(*STREAM, "_at", "frame_number", (F.col("_upto") - ends).alias("_base"),
                          F.posexplode(pieces).alias("_i", "piece")).filter(F.col("piece") != "")
    letters = F.length(F.regexp_replace("piece", r"\s", ""))
    # a capability line has at most twelve visible characters, so at most twelve of its pieces have
    # any; pieces of blanks alone may be any number, and shrink to one entry per gap between those
    line = [*STREAM, "_line"]
    numbered = rows.withColumn("_line", F.col("_base") + F.col("_i")).withColumn("_letters", letters)
    sizes = numbered.groupBy(*line).agg(F.sum("_letters").alias("_sum")).filter("_sum between 1 and 12").drop("_sum")
    short = lineage.cut(numbered.join(sizes, line).select(*line, "_at", "frame_number", "_letters", "piece"))
    seen = short.filter("_letters > 0").groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("_at", "frame_number", "piece"))).alias("_p"))
    place = F.struct("_at", "frame_number")
    gap = F.size(F.filter("_p", lambda p: F.struct(p["_at"].alias("_at"), p["frame_number"].alias("frame_number")) < place))
    blanks = short.filter("_letters = 0").join(seen, line).select(*line, gap.alias("_gap"), "piece").groupBy(*line, "_gap").agg(
        F.sum(F.length("piece")).alias("_n"), F.min("piece").alias("_b"))
    gaps = blanks.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("_gap", F.when(F.col("_n") == 1, F.col("_b")).otherwise("  ")))).alias("_gaps"))
    between = lambda i: F.coalesce(F.col("_gaps")[i], F.lit(""))
    body = F.concat(between(F.lit(0)), F.array_join(F.transform("_p", lambda p, i: F.concat(p["piece"], between(i + 1))), ""))
    text = F.regexp_replace(body, f"({LINE_MARK}|\r)+$", "")
    found = seen.join(gaps, line, "left").filter(text.rlike(vocab.CAPABILITY_LINE)).select(*line)
    return short.join(found, line, "left_semi").select(*STREAM, "frame_number").distinct()


# -------------------------------------------------------------------------------- evidence
EVENT_KINDS = ["starttls_advertised", "capability_response", "starttls_command",
               "starttls_accepted", "starttls_rejected", "auth_command", "plaintext_command"]


def event_facts(events: DataFrame) -> DataFrame:
    """Per stream: count, first and last frame of each kind, and the totals features need."""
    n = F.col("frame_number")
    out = [F.count(F.lit(1)).alias("n_events"), F.countDistinct("kind").alias("n_event_kinds"),
           F.bool_or(F.col("kind") == "greeting").alias("has_greeting"),
           F.bool_or(F.col("kind").startswith("capabilit")).alias("has_capability"),
           F.count_if(F.col("direction") == "CLIENT_TO_SERVER").alias("c2s_events"),
           F.count_if(F.col("direction") == "SERVER_TO_CLIENT").alias("s2c_events")]
    for kind in EVENT_KINDS:
        mine = F.when(F.col("kind") == kind, n)
        out += [F.count(mine).alias(f"{kind}_n"), F.min(mine).alias(f"{kind}_lo"),
                F.max(mine).alias(f"{kind}_hi")]
    return events.groupBy(*STREAM).agg(*out)


def _fr(kind: str) -> tuple:
    return F.col(f"{kind}_lo"), F.col(f"{kind}_hi"), F.col(f"{kind}_n")


def _n(kind: str) -> Column:
    return F.coalesce(F.col(f"{kind}_n"), F.lit(0))


def bool_evidence(kind: str, yes: str, no: str) -> Column:
    return F.when(_n(kind) > 0, ev.observed("true", yes, _fr(kind))).otherwise(ev.observed("false", no))


def acceptance_evidence() -> Column:
    a, r = _n("starttls_accepted"), _n("starttls_rejected")
    both = (F.least("starttls_accepted_lo", "starttls_rejected_lo"),
            F.greatest("starttls_accepted_hi", "starttls_rejected_hi"), a + r)
    return (F.when((a > 0) & (r > 0), ev.ambiguous(None, "contradictory server responses", both))
            .when(a > 0, ev.observed("true", "server accepted the upgrade", _fr("starttls_accepted")))
            .when(r > 0, ev.observed("false", "server rejected the upgrade", _fr("starttls_rejected")))
            .when(_n("starttls_command") > 0, ev.unknown("no server response was captured"))
            .otherwise(ev.unknown("no upgrade command observed")))


def advert_evidence() -> Column:
    """Absence is ambiguous, never false: stripped and unsupported look the same."""
    return (F.when(_n("starttls_advertised") > 0,
                   ev.observed("true", "upgrade capability listed", _fr("starttls_advertised")))
            .when(F.coalesce("rejoined_n", F.lit(0)) > 0, ev.observed(
                "true", "capability line recovered from rejoined segments",
                (F.col("rejoined_lo"), F.col("rejoined_hi"), F.col("rejoined_n"))))
            .when(_n("capability_response") > 0, ev.ambiguous(
                "false", "capability reply without the upgrade capability", _fr("capability_response")))
            .otherwise(ev.unknown("no capability reply observed")))


def _version_name(raw: Column) -> Column:
    return casts.lookup({str(k): v for k, v in vocab.TLS_VERSIONS.items()},
                        casts.to_int_decimal(raw).cast("string"), F.lit(None).cast("string"))


def negotiated_version() -> Column:
    """First ServerHello only; the supported_versions extension outranks the legacy field."""
    h = F.col("hello")
    fr = (h["frame"], h["frame"], F.lit(1))
    supported, legacy = _version_name(h["supported"]), _version_name(h["version"])
    return (F.when(h.isNull(), ev.unknown("no ServerHello observed"))
            .when(supported.isNotNull(), ev.observed(supported, "supported_versions extension", fr))
            .when(legacy.isNotNull(), ev.observed(legacy, "ServerHello version field", fr))
            .otherwise(ev.ambiguous(None, "version value not recognised", fr)))


def negotiated_cipher() -> Column:
    h = F.col("hello")
    code = casts.to_int_decimal(h["suite"])
    fr = (h["frame"], h["frame"], F.lit(1))
    return (F.when(h.isNull(), ev.unknown("no ServerHello observed"))
            .when(h["suite"].isNull(), ev.unknown("ServerHello without a cipher suite"))
            .when(code.isNotNull(), ev.observed(F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(code), 4, "0"))),
                                                "suite selected in the ServerHello", fr))
            .otherwise(ev.ambiguous(None, "cipher suite value not recognised", fr)))


def tls_transition() -> Column:
    fr = (F.col("tls_lo"), F.col("tls_hi"), F.col("tls_n"))
    done, implicit = F.col("tls_state") == "ESTABLISHED", F.col("implicit_tls")
    return (F.when(~implicit & (F.col("tls_state") == "NONE"), ev.observed("false", "no TLS records in this stream"))
            .when(done, ev.observed("true", "hellos and application data observed", fr))
            .otherwise(ev.ambiguous(None, "completion unproven", fr)))


def upgrade_point() -> Column:
    """First frame of the accepted upgrade or of the completed handshake, whichever comes first."""
    return F.least("accepted_frame", F.when(F.col("stream_tls") == "ESTABLISHED", F.col("tls_lo")))


def plaintext_after() -> Column:
    """Cleartext dialogue after the upgrade point; without one, any cleartext command."""
    boundary = upgrade_point()
    clear = _n("plaintext_command") + _n("auth_command")
    last_clear = F.greatest("plaintext_command_hi", "auth_command_hi", "capability_response_hi")
    return (F.when(boundary.isNull() & (clear > 0), ev.observed(
                "true", "cleartext activity and no upgrade",
                (F.least("plaintext_command_lo", "auth_command_lo"),
                 F.greatest("plaintext_command_hi", "auth_command_hi"), clear)))
            .when(boundary.isNull(), ev.observed("false", "no cleartext activity"))
            .when(F.coalesce(last_clear > boundary, F.lit(False)), ev.observed(
                "true", "cleartext activity after the upgrade point", (last_clear, last_clear, F.lit(1))))
            .otherwise(ev.observed("false", "no cleartext activity after the upgrade point")))


def completeness() -> Column:
    """COMPLETE needs both ends; an open stream is TRUNCATED only when the capture ends on it."""
    closed = F.col("teardown") | F.col("reset")
    at_end = F.col("last_frame") >= F.col("capture_last_frame")
    return (F.when(F.col("mail") & F.col("setup") & closed, "COMPLETE").when(closed, "INCOMPLETE")
            .when(at_end | F.col("capture_truncated"), "TRUNCATED").otherwise("INCOMPLETE"))


# -------------------------------------------------------------------------------- assembly
@dataclass(frozen=True)
class Rebuilt:
    """What a rebuild writes once and its tables share: facts of a stream, deduplicated events, the
    walk over them, frames of rejoined lines, frames with TLS, and all that is known of a stream."""
    events: DataFrame
    steps: DataFrame
    rejoined: DataFrame
    tls_frames: DataFrame
    known: DataFrame


def rebuild(frames: DataFrame, truncated_captures: DataFrame | None = None) -> Rebuilt:
    """Streams of `frames`, read three times: for facts, for the dialogue, and for TLS frames.

    `truncated_captures` lists captures the dissector reported as cut; without it only the
    stream that owns the last frame of a capture can be called truncated.
    """
    # packets outside any stream form one group of their own; -1 keeps them joinable
    frames = frames.withColumn("tcp_stream_id", F.coalesce("tcp_stream_id", F.lit(-1)))
    facts = lineage.cut(stream_facts(frames))
    directed = lineage.cut(with_direction(frames, facts.filter("protocol is not null and not implicit")))
    events = lineage.cut(dedupe_events(mail_events(directed)))
    steps = lineage.cut(walk_states(events))
    walked = steps.filter(F.col("to_state").isNotNull()).groupBy(*STREAM).agg(
        F.count(F.lit(1)).alias("walk_transitions"),
        F.max_by("to_state", F.struct("frame_number", "pos", "kind", "detail")).alias("walk_state"),
        F.min(F.when(F.col("kind") == "starttls_accepted", F.col("frame_number"))).alias("accepted_frame"))
    rejoined = lineage.cut(reassembled_advert(directed))
    lines = rejoined.groupBy(*STREAM).agg(
        F.min("frame_number").alias("rejoined_lo"), F.max("frame_number").alias("rejoined_hi"),
        F.count(F.lit(1)).alias("rejoined_n"))
    known = facts.join(event_facts(events), STREAM, "left").join(walked, STREAM, "left").join(lines, STREAM, "left")
    if truncated_captures is not None:
        cut = truncated_captures.select("capture_id").distinct().withColumn("capture_truncated", F.lit(True))
        known = known.join(cut, "capture_id", "left")
    else:
        known = known.withColumn("capture_truncated", F.lit(False))
    known = lineage.cut(known.withColumn("capture_truncated", F.coalesce("capture_truncated", F.lit(False))))
    return Rebuilt(events, steps, rejoined, frames.filter("tls.present").select(*STREAM, "frame_number"), known)


def reconstruct_sessions(spark: SparkSession, frames: DataFrame,
                         truncated_captures: DataFrame | None = None) -> DataFrame:
    """One row per stream in the session schema."""
    return sessions_of(spark, rebuild(frames, truncated_captures))


def sessions_of(spark: SparkSession, parts: Rebuilt) -> DataFrame:
    """The session rows of a rebuild; first, last and number of the frames behind each field are
    those of `evidence_frames`."""
    base = lineage.cut(assemble(spark, parts.known))
    return counted(base, provenance_of(parts, base)).drop("x509_frame", "_stream")


def counted(base: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sessions whose evidence names the frames that `provenance` lists."""
    each = provenance.groupBy("capture_id", F.col("tcp_stream_id").alias("_stream"), "field").agg(
        F.struct(F.min("frame_number").alias("lo"), F.max("frame_number").alias("hi"), F.count(F.lit(1)).alias("n")).alias("f"))
    fields = each.groupBy("capture_id", "_stream").agg(F.map_from_entries(F.collect_list(F.struct("field", "f"))).alias("_frames"))
    joined = base.join(fields, ["capture_id", "_stream"], "left")
    of = lambda f, part: F.col("_frames")[f][part]
    return joined.withColumns({f: F.col(f).withField("frame_lo", of(f, "lo")).withField("frame_hi", of(f, "hi"))
                               .withField("frame_n", F.coalesce(of(f, "n"), F.lit(0).cast("bigint"))) for f in vocab.EVIDENCE_FIELDS}).drop("_frames")


def assemble(spark: SparkSession, joined: DataFrame) -> DataFrame:
    na = ev.not_observable("implicit TLS has no cleartext dialogue")
    mail = F.col("protocol").isNotNull()
    joined = joined.withColumn("_stream", F.col("tcp_stream_id")) \
        .withColumn("tcp_stream_id", F.when(F.col("tcp_stream_id") >= 0, F.col("tcp_stream_id")))
    base = joined.withColumns({
        "mail": mail, "implicit_tls": mail & F.col("implicit"),
        "tls_state": F.when(mail, F.col("stream_tls")).otherwise("NONE"),
        "hello": F.when(mail, F.col("hello")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("n_events", "n_event_kinds", "c2s_events", "s2c_events",
                                               "walk_transitions")},
        "has_greeting": F.coalesce("has_greeting", F.lit(False)),
        "has_capability": F.coalesce("has_capability", F.lit(False))})
    base = base.withColumn("completeness", completeness())
    implicit, idle = F.col("implicit_tls"), ev.unknown("no mail dialogue in this stream")
    pick = lambda explicit: F.when(~F.col("mail"), idle).when(implicit, na).otherwise(explicit)
    upgraded = (F.when(F.col("tls_state") == "ESTABLISHED", "TLS_ESTABLISHED")
                .when(F.col("tls_state") == "NONE", F.coalesce("walk_state", F.lit("CONNECTED")))
                .otherwise("TLS_NEGOTIATING"))
    closes = (F.col("completeness") == "COMPLETE") & (upgraded != "TLS_ESTABLISHED")
    app = (F.when(~F.col("mail"), "CONNECTED").when(implicit, "IMPLICIT_TLS")
           .when(closes, "CLOSED").otherwise(upgraded))
    transitions = (F.when(~F.col("mail"), 0).when(implicit, 1)
                   .otherwise(F.col("walk_transitions") + (F.col("tls_state") != "NONE").cast("int")
                              + closes.cast("int")))
    chain = crypto.build_chain(base.withColumns({
        "starttls_advertised": pick(advert_evidence()),
        "starttls_requested": pick(bool_evidence("starttls_command", "client sent the upgrade command",
                                                 "no upgrade command observed")),
        "starttls_accepted": pick(acceptance_evidence()),
        "auth_activity": pick(bool_evidence("auth_command", "authentication command observed",
                                            "no authentication command observed")),
        "tls_transition": F.when(~F.col("mail"), idle).otherwise(tls_transition()),
        "tls_negotiated_version": negotiated_version(), "tls_cipher_suite": negotiated_cipher(),
        "plaintext_continuation": F.when(~F.col("mail"), idle)
        .when(implicit, ev.observed("false", "encrypted from the first record")).otherwise(plaintext_after()),
        "app_state": app, "n_transitions": transitions,
        "suite_code": crypto.parse_code(F.col("hello.suite")),
        "group_code": crypto.parse_code(F.col("hello.share")),
        "first_auth_frame": F.col("auth_command_lo"),
        "first_tls_frame": F.when(~implicit, F.col("tls_lo")),
        "stream_key": F.when(F.col("tcp_stream_id").isNotNull(),
                             F.concat_ws(":", "capture_id", F.col("tcp_stream_id").cast("string"))),
        "x509": F.when(F.col("mail"), F.col("x509"))}))
    return crypto.enrich_sessions(spark, chain).select(
        "capture_id", "tcp_stream_id", "stream_key", "protocol", "client_ip", "client_port", "server_ip",
        "server_port", "endpoint_basis", "first_frame", "last_frame", "start_epoch", "end_epoch",
        "packet_count", "setup", "teardown", "reset", "completeness", "app_state", "tls_state",
        "implicit_tls", *vocab.EVIDENCE_FIELDS, "certificates", "chain_links", "chain_signature_oids",
        "n_events", "n_event_kinds", "n_transitions", "has_greeting", "has_capability", "c2s_events",
        "s2c_events", "first_auth_frame", "first_tls_frame", "x509_frame", "_stream")


#: fields a ServerHello decides
HELLO_FIELDS = ["tls_negotiated_version", "tls_cipher_suite", "tls_cipher_suite_name", "tls_key_exchange",
                "tls_named_group", "tls_forward_secrecy"]


def provenance_of(parts: Rebuilt, base: DataFrame) -> DataFrame:
    """(capture_id, tcp_stream_id, field, frame_number, role): one row for each evidence field of a
    session and each frame behind it, so no list can outgrow a row.  -1 is the group outside streams.

    An advertisement rests on the events that list it, else on the frames of a rejoined line, else on
    the replies that lack it; cleartext on what follows the upgrade point, or without one on every
    cleartext command."""
    decided = parts.known.select(*STREAM, upgrade_point().alias("_point"), (_n("starttls_advertised") > 0).alias("_listed"),
                                 (F.coalesce("rejoined_n", F.lit(0)) > 0).alias("_rejoined"))
    kind, point = F.col("kind"), F.col("_point")
    def row(test, field, role):
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(role).alias("role")))
    clear = kind.isin("plaintext_command", "auth_command")
    rows = F.array_compact(F.array(
        row(kind == "starttls_advertised", "starttls_advertised", "capability"),
        row((kind == "capability_response") & ~F.col("_listed") & ~F.col("_rejoined"), "starttls_advertised", "capability reply"),
        row(kind == "starttls_command", "starttls_requested", "upgrade command"),
        row(kind == "starttls_accepted", "starttls_accepted", "acceptance"),
        row(kind == "starttls_rejected", "starttls_accepted", "rejection"),
        row(kind == "auth_command", "auth_activity", "authentication"),
        row(point.isNull() & clear, "plaintext_continuation", "cleartext"),
        row((F.col("frame_number") > point) & (clear | (kind == "capability_response")), "plaintext_continuation", "cleartext after upgrade")))
    told = parts.events.filter("frame_number is not null").select(*STREAM, "frame_number", "kind").distinct() \
        .join(decided, STREAM).select(*STREAM, "frame_number", F.inline(rows))
    lines = parts.rejoined.join(decided.filter("not _listed"), STREAM, "left_semi") \
        .select(*STREAM, "frame_number", F.lit("starttls_advertised").alias("field"), F.lit("rejoined line").alias("role"))
    tls = parts.tls_frames.join(parts.known.filter("protocol is not null"), STREAM, "left_semi") \
        .select(*STREAM, "frame_number", F.lit("tls_transition").alias("field"), F.lit("tls record").alias("role"))
    hello = F.array_compact(F.array(
        *[F.when(F.col(f"{f}.frame_n") > 0, F.struct(F.lit(f).alias("field"), F.col(f"{f}.frame_lo").alias("frame_number"), F.lit("server hello").alias("role")))
          for f in HELLO_FIELDS],
        F.when(F.col("tls_certificate_chain.value").isNotNull(), F.struct(
            F.lit("tls_certificate_chain").alias("field"), F.col("x509_frame").alias("frame_number"), F.lit("certificate").alias("role")))))
    shaken = base.select("capture_id", F.col("_stream").alias("tcp_stream_id"), F.inline(hello))
    every = told.unionByName(lines).unionByName(tls).unionByName(shaken)
    # a frame that backs a field in two roles (an accepted and a rejected upgrade) counts once
    return every.groupBy(*STREAM, "field", "frame_number").agg(F.min("role").alias("role"))


def evidence_frames(spark: SparkSession, parts: Rebuilt) -> DataFrame:
    """The frames behind all thirteen evidence fields of every session; a null stream is the group
    outside streams."""
    return outside(provenance_of(parts, assemble(spark, parts.known)))


def outside(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tcp_stream_id", F.when(F.col("tcp_stream_id") >= 0, F.col("tcp_stream_id")))


# ------------------------------------------------------------------------------ transitions
def _finish(parts: Rebuilt, base: DataFrame) -> DataFrame:
    """The steps after the dialogue: implicit TLS, the handshake, the close; with their frames."""
    state = F.coalesce("walk_state", F.lit("CONNECTED"))
    joined = base.select("capture_id", F.col("_stream").alias("tcp_stream_id"), "completeness", "implicit_tls", "tls_state", "app_state") \
        .join(parts.known.filter("protocol is not null").select(*STREAM, "walk_state", "tls_lo", "tls_hi", "tls_n", "last_frame"), STREAM)
    done, implicit = F.col("tls_state") == "ESTABLISHED", F.col("implicit_tls")
    upgraded = F.when(done, "TLS_ESTABLISHED").otherwise("TLS_NEGOTIATING")
    before_close = F.when(F.col("tls_state") == "NONE", state).otherwise(upgraded)

    def step(phase, event, start, to, lo, hi, n, basis):
        return F.struct(F.lit(phase).alias("phase"), event.alias("event"), start.alias("from_state"), to.alias("to_state"), lo.alias("frame_lo"),
                        hi.alias("frame_hi"), n.cast("bigint").alias("frame_n"), basis.alias("basis"))
    records = (F.col("tls_lo"), F.col("tls_hi"), F.col("tls_n"))
    end = F.col("last_frame")
    steps = F.array_compact(F.array(
        F.when(implicit, step(1, F.lit("implicit_tls"), F.lit("CONNECTED"), F.lit("IMPLICIT_TLS"), *records, F.lit("implicit-TLS port"))),
        F.when(~implicit & (F.col("tls_state") != "NONE"), step(
            1, F.when(done, "tls_established").otherwise("tls_negotiation_observed"), state, upgraded, *records,
            F.when(done, "handshake plus application data").otherwise(F.col("tls_state")))),
        F.when(F.col("app_state") == "CLOSED", step(2, F.lit("connection_closed"), before_close, F.lit("CLOSED"), end, end, F.when(end.isNotNull(), 1).otherwise(0),
                                                    F.lit("FIN or RST observed")))))
    return joined.select(*STREAM, F.inline(steps)).withColumns({"pos": F.lit(0), "timestamp_epoch": F.lit(None).cast("double")})


def session_transitions(spark: SparkSession, parts: Rebuilt) -> DataFrame:
    """Every state change of every session in order, with the frames, time and basis behind it.

    `step` counts from 1 within a session; blocks of frames are ranked on their own, so a stream of
    any length is no single task.  The last step's `to_state` is the session's `app_state`."""
    walk = parts.steps.filter(F.col("to_state").isNotNull()).select(
        *STREAM, F.lit(0).alias("phase"), F.col("kind").alias("event"), "from_state", "to_state", F.col("frame_number").alias("frame_lo"),
        F.col("frame_number").alias("frame_hi"), F.when(F.col("frame_number").isNotNull(), 1).otherwise(0).cast("bigint").alias("frame_n"),
        F.when(F.col("detail") != "", F.col("detail")).otherwise(F.col("kind")).alias("basis"), "pos", "timestamp_epoch")
    every = walk.unionByName(_finish(parts, assemble(spark, parts.known)))
    blocked = every.withColumn("_block", F.col("phase") * F.lit(1 << 44) + F.floor(F.coalesce("frame_lo", F.lit(0)) / (FRAME_RANGE * 64)))
    ranked = skew.ordinals(blocked, STREAM, "_block", ["phase", F.coalesce("frame_lo", F.lit(0)), "pos", "event", "basis"], "step")
    return outside(ranked.select(*STREAM, "step", "event", "from_state", "to_state", "frame_lo", "frame_hi", "frame_n", "timestamp_epoch",
                                 F.lit("OBSERVED").alias("evidence_state"), "basis"))


def session_notes(spark: SparkSession, parts: Rebuilt) -> DataFrame:
    """What a session's record leaves open: events that were out of order, and missing boundaries."""
    ignored = parts.steps.filter(F.col("to_state").isNull()).select(
        *STREAM, "frame_number", F.concat(F.lit("out of order: "), "kind", F.lit(" in state "), "from_state").alias("note"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    closed = F.col("teardown") | F.col("reset")
    open_ = assemble(spark, parts.known).filter(F.col("protocol").isNotNull() & ~(F.col("setup") & closed)).select(
        "capture_id", F.col("_stream").alias("tcp_stream_id"), F.col("last_frame").alias("frame_number"),
        F.concat(F.lit("boundaries incomplete: setup "), yes("setup"), F.lit(", teardown "), F.when(closed, "yes").otherwise("no"),
                 F.when(F.col("completeness") == "TRUNCATED", ", capture ends while open").otherwise(", capture goes on")).alias("note"))
    return outside(ignored.unionByName(open_))


def timeline_parts(spark: SparkSession, parts: Rebuilt) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, evidence, transitions) of every session, as the timeline merges them."""
    events = parts.events.select(*STREAM, "frame_number", F.col("kind").alias("title"))
    fields = provenance_of(parts, assemble(spark, parts.known)).select(*STREAM, "frame_number", F.col("field").alias("title"))
    steps = parts.steps.filter(F.col("to_state").isNotNull()).select(
        *STREAM, "frame_number", F.col("kind").alias("title"), F.col("timestamp_epoch").alias("time"))
    ends = _finish(parts, assemble(spark, parts.known)).select(
        *STREAM, F.col("frame_lo").alias("frame_number"), F.col("event").alias("title"), F.col("timestamp_epoch").alias("time"))
    return events, fields, steps.unionByName(ends)
