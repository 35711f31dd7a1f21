"""Dialogue walk and segment reassembly on hand-made streams."""

from pyspark.sql import functions as F

from wirepost.functions import vocab
from wirepost.operators import sessions as se


def walk(kinds):
    edges = {(k, a): b for k, a, b in vocab.DIALOGUE_EDGES}
    state, out = "CONNECTED", []
    for i, k in enumerate(kinds):
        to = edges.get((k, state))
        out.append((i * 700, state, to))
        state = to or state
    return out


def test_walk_across_frame_ranges(spark):
    kinds = ["capability_response", "greeting", "capability_request", "greeting", "capability_response",
             "starttls_advertised", "plaintext_command", "auth_command", "starttls_command", "auth_command"]
    rows = [("c", 1, i * 700, 0, k, "", None) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "capture_id string, tcp_stream_id long, frame_number long, pos int, kind string, "
                                     "detail string, timestamp_epoch double").repartition(3)
    got = sorted((r["frame_number"], r["from_state"], r["to_state"]) for r in se.walk_states(df).collect())
    assert got == walk(kinds)


def directed(spark, payloads, end=None):
    """One SMTP stream: an EHLO at frame 1, then (frame, seq, payload) from the server."""
    mail = lambda cmd: {"smtp_command_line": cmd, "smtp_command": None}
    rows = [("c", 1, 1, None, "CLIENT_TO_SERVER", "smtp", False, None, mail("EHLO x"))]
    rows += [("c", 1, n, s, "SERVER_TO_CLIENT", "smtp", False, p, mail(None)) for n, s, p in payloads]
    if end:
        rows.append(("c", 1, end, None, "CLIENT_TO_SERVER", "smtp", False, None, mail("STARTTLS")))
    return spark.createDataFrame(rows, "capture_id string, tcp_stream_id long, frame_number long, tcp_seq long, direction string, "
                                       "protocol string, implicit boolean, payload_text string, "
                                       "mail struct<smtp_command_line:string,smtp_command:string>")


def frames_of(df):
    return sorted(r["frame_number"] for r in se.reassembled_advert(df).collect())


def test_capability_split_over_segments(spark):
    assert frames_of(directed(spark, [(2, 10, "250-mail\r\n250-STAR"), (3, 30, "TTLS\r\n250 OK\r\n")])) == [2, 3]


def test_out_of_order_and_retransmitted_segments(spark):
    parts = [(2, 30, "TTLS\r"), (3, 10, "250-mail\r\n250-STAR"), (4, 10, "250-mail\r\n250-STAR"), (5, 40, "\n250 OK\r\n")]
    assert frames_of(directed(spark, parts)) == [2, 3]


def test_mention_is_no_capability_and_window_ends(spark):
    assert frames_of(directed(spark, [(2, 10, "250-we like STARTTLS\r\n")])) == []
    assert frames_of(directed(spark, [(9, 10, "250-STARTTLS\r\n")], end=5)) == []


def test_bad_utf8_payload_is_replaced(spark):
    from wirepost.functions import casts
    df = spark.createDataFrame([("2b:4f:4b:ff",), ("zz",), (None,)], "h string")
    got = [r[0] for r in df.select(casts.decode_payload(F.col("h"))).collect()]
    assert got == ["+OK�", None, None]
