"""Packet text to assessment: known scores, one evaluation per stage, frames behind the evidence."""

import json

import pytest
from pyspark.sql import functions as F

from queries import lifts
from wirepost.functions import vocab
from wirepost.operators import sessions as se
from wirepost.plans import assessment, lineage
from wirepost.sources import ek

SF = "/root/testdata/sf0.001"
CLIENT, SERVER = ("10.0.0.1", "40001"), ("10.0.0.2", "587")


def packet(n, stream, from_server, flags="0x0018", stack="eth:ip:tcp:smtp", **layers):
    src, dst = (SERVER, CLIENT) if from_server else (CLIENT, SERVER)
    return json.dumps({"timestamp": "1", "layers": {
        "frame": {"frame_frame_number": str(n), "frame_frame_time_epoch": f"{1700000000 + n}.5", "frame_frame_protocols": stack},
        "ip": {"ip_ip_src": src[0], "ip_ip_dst": dst[0]},
        "tcp": {"tcp_tcp_srcport": [src[1]], "tcp_tcp_dstport": dst[1], "tcp_tcp_stream": str(stream), "tcp_tcp_seq": str(10 * n), "tcp_tcp_flags": flags},
        **layers}})


def smtp(**fields):
    return {"smtp": {f"smtp_smtp_{k}": v for k, v in fields.items()}}


def tls(**fields):
    return {"tls": {f"tls_tls_{k}": v for k, v in fields.items()}}


def opening(stream, n):
    return [packet(n, stream, False, "0x0002", "eth:ip:tcp"), packet(n + 1, stream, True, "0x0012", "eth:ip:tcp"),
            packet(n + 2, stream, True, **smtp(rsp_parameter=["mail.example.org ESMTP"], response_code="220")),
            packet(n + 3, stream, False, **smtp(req_command="EHLO", command_line="EHLO client.example"))]


def cleartext(stream, n):
    """A login without any protection: a HIGH and a MEDIUM issue, 28 and 12 points."""
    return [*opening(stream, n), packet(n + 4, stream, True, **smtp(rsp_parameter=["mail", "PIPELINING"], response_code="250")),
            packet(n + 5, stream, False, **smtp(req_command="AUTH", command_line="AUTH PLAIN")),
            packet(n + 6, stream, False, "0x0011", "eth:ip:tcp")]


def upgraded(stream, n):
    """A STARTTLS session that ends in TLS 1.3: nothing to penalise."""
    return [*opening(stream, n), packet(n + 4, stream, True, **smtp(rsp_parameter=["mail", "STARTTLS"], response_code="250")),
            packet(n + 5, stream, False, **smtp(req_command="STAR", command_line="STARTTLS")),
            packet(n + 6, stream, True, **smtp(rsp_parameter=["2.0.0 Ready to start TLS"], response_code="220")),
            packet(n + 7, stream, False, stack="eth:ip:tcp:tls", **tls(record_version="0x0303", handshake_type="1")),
            packet(n + 8, stream, True, stack="eth:ip:tcp:tls", **tls(record_version="0x0303", handshake_type="2", handshake_version="771",
                   handshake_ciphersuite="4865", handshake_extensions_supported_version="772", handshake_extensions_key_share_group="29")),
            packet(n + 9, stream, False, stack="eth:ip:tcp:tls", **tls(record_version="0x0303", app_data="17:03")),
            packet(n + 10, stream, False, "0x0011", "eth:ip:tcp")]


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    (folder / "open.json").write_text("\n".join(['{"index":{}}', *cleartext(0, 1), "{broken"]))
    (folder / "safe.json").write_text("\n".join([*upgraded(0, 1), *upgraded(1, 101)]))
    return str(folder)


def scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in x]


@pytest.fixture(scope="module")
def made(spark, captures):
    """One run, and the scans of every table it writes by a checkpoint."""
    plans, real = [], lineage.cut
    lineage.cut = lambda df: plans.append(scans(df)) or real(df)
    try:
        return assessment.assess_packets(spark, ek.frames_from(ek.read_ek(spark, captures))), plans
    finally:
        lineage.cut = real


@pytest.fixture(scope="module")
def parts(spark):
    return se.rebuild(lifts.frames(spark, SF))


def test_two_captures_with_known_scores(made):
    run, _ = made
    got = {r["capture_id"].rsplit("-", 1)[0]: r for r in run.posture().collect()}
    assert (got["open"]["value"], got["open"]["band"], got["open"]["sessions_assessed"]) == (60.0, "WEAK", 1)
    assert (got["safe"]["value"], got["safe"]["band"], got["safe"]["sessions_assessed"]) == (100.0, "STRONG", 2)
    issues = {(r["issue_class"], r["severity"]) for r in run.groups.filter("penalising").collect()}
    assert {s for _, s in issues} == {"HIGH", "MEDIUM"} and len(issues) == 2
    states = {(r["capture_id"].rsplit("-", 1)[0], r["tcp_stream_id"]): (r["app_state"], r["tls_state"]) for r in run.sessions.collect()}
    assert states == {("open", 0): ("CLOSED", "NONE"), ("safe", 0): ("TLS_ESTABLISHED", "ESTABLISHED"), ("safe", 1): ("TLS_ESTABLISHED", "ESTABLISHED")}


def test_order_of_packets_and_anomalies_do_not_move_the_score(spark, captures, made):
    cols = ["capture_id", "value", "band"]
    frames = ek.frames_from(ek.read_ek(spark, captures)).repartition(7, "tcp_seq")
    mixed = sorted(map(tuple, assessment.assess_packets(spark, frames, ai=True).posture().select(*cols).collect()))
    assert mixed == sorted(map(tuple, made[0].posture().select(*cols).collect())) and len(mixed) == 2


def test_frames_are_read_three_times_and_stages_once(made):
    run, plans = made
    of_frames = [x for p in plans for x in p if "/frames" in x.split("Location")[-1].split("]")[0]]
    assert 1 <= len(of_frames) <= 3
    assert len(scans(run.posture())) < 25


def test_steps_and_evidence_of_the_upgrade(spark, captures):
    parts = se.rebuild(ek.frames_from(ek.read_ek(spark, captures)).filter(F.col("capture_id").startswith("safe")))
    steps = [(r["event"], r["to_state"], r["frame_lo"], r["frame_n"]) for r in se.session_transitions(spark, parts).filter("tcp_stream_id = 1").orderBy("step").collect()]
    assert steps == [("greeting", "GREETING_OBSERVED", 103, 1), ("capability_request", "CAPABILITY_REQUESTED", 104, 1), ("capability_response", "CAPABILITY_OBSERVED", 105, 1),
                     ("starttls_advertised", "STARTTLS_ADVERTISED", 105, 1), ("starttls_command", "STARTTLS_REQUESTED", 106, 1),
                     ("starttls_accepted", "STARTTLS_ACCEPTED", 107, 1), ("tls_established", "TLS_ESTABLISHED", 108, 3)]
    frames = {}
    for r in se.evidence_frames(spark, parts).filter("tcp_stream_id = 0").collect():
        frames.setdefault(r["field"], []).append(r["frame_number"])
    hello = {f: [9] for f in se.HELLO_FIELDS}
    assert {k: sorted(v) for k, v in frames.items()} == hello | {"starttls_advertised": [5], "starttls_requested": [6], "starttls_accepted": [7], "tls_transition": [8, 9, 10]}


def test_counts_on_the_session_are_rows_of_the_table(spark, parts):
    rows = {}
    for r in se.evidence_frames(spark, parts).collect():
        rows.setdefault((r["capture_id"], r["tcp_stream_id"], r["field"]), []).append(r["frame_number"])
    seen = set()
    for s in se.sessions_of(spark, parts).collect():
        for f in vocab.EVIDENCE_FIELDS:
            own = rows.get((s["capture_id"], s["tcp_stream_id"], f), [])
            assert (s[f]["frame_n"], s[f]["frame_lo"], s[f]["frame_hi"]) == (len(own), min(own, default=None), max(own, default=None))
            seen |= {f} if own else set()
    assert seen == set(vocab.EVIDENCE_FIELDS)


def test_last_step_is_the_state_of_the_session(spark, parts):
    last = {}
    for r in se.session_transitions(spark, parts).collect():
        last[(r["capture_id"], r["tcp_stream_id"])] = max(last.get((r["capture_id"], r["tcp_stream_id"]), (0, "")), (r["step"], r["to_state"]))
    for s in se.sessions_of(spark, parts).collect():
        assert last.get((s["capture_id"], s["tcp_stream_id"]), (0, "CONNECTED"))[1] == s["app_state"]
        assert last.get((s["capture_id"], s["tcp_stream_id"]), (0, ""))[0] == s["n_transitions"]


def test_a_stream_of_a_million_events(spark):
    kinds = ["greeting", "capability_request", "capability_response", "plaintext_command", "auth_command"]
    events = spark.range(0, 1_000_000, numPartitions=8).select(
        F.lit("c").alias("capture_id"), F.lit(1).cast("long").alias("tcp_stream_id"), F.col("id").alias("frame_number"), F.lit(0).alias("pos"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 5 + 1).cast("int")).alias("kind"), F.lit("").alias("detail"),
        F.col("id").cast("double").alias("timestamp_epoch"))
    got = se.walk_states(events).groupBy("to_state").count().collect()
    edges, state, want = {(k, a): b for k, a, b in vocab.DIALOGUE_EDGES}, "CONNECTED", {}
    for i in range(1_000_000):
        to = edges.get((kinds[i % 5], state))
        want[to] = want.get(to, 0) + 1
        state = to or state
    assert {r["to_state"]: r["count"] for r in got} == want


def test_an_endless_line_of_blanks_is_no_row_of_its_own(spark):
    from test_sessions import directed, frames_of
    blanks = [(3 + i, 20 + i, " ") for i in range(500)]
    assert frames_of(directed(spark, [(2, 10, "250-STARTTLS"), *blanks, (900, 900, "\r\n")])) == [2, *range(3, 503), 900]
    assert frames_of(directed(spark, [(2, 10, "250-STAR"), *blanks, (900, 900, "TTLS\r\n")])) == []
    assert frames_of(directed(spark, [(2, 10, "250"), (3, 20, " "), (4, 21, "STARTTLS\r\n")])) == [2, 3, 4]


def test_layers_that_share_a_name_are_merged_and_others_are_strung(spark):
    """A later layer wins over an earlier one, a field beside the layers over both."""
    packets = [{"a": {"x": "1", "y": "2"}, "b": {"z": "3"}, "n": "4"}, {"a": {"x": "1", "y": "2"}, "b": {"x": "5"}, "y": "6"},
               {"a": {}, "b": {"x": ["7"]}, "c": "{broken"}, {"n": None}, {}]
    lines = spark.createDataFrame([(i, json.dumps({"layers": p})) for i, p in enumerate(packets)], "i int, value string")
    got = {r.i: r.flat for r in ek.flatten_layers(ek.parse_ek(lines)).collect()}
    assert got == {0: {"x": "1", "y": "2", "z": "3", "n": "4"}, 1: {"x": "5", "y": "6"}, 2: {"x": '["7"]'}, 3: {"n": None}, 4: {}}


def test_packets_are_dissected_by_all_tasks(spark):
    """However few files and splits the events have."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines, flat = lifts.ek_lines(spark, SF), lifts.flat_frames(spark, SF)
    assert spark.read.parquet(f"{SF}/events.parquet").rdd.getNumPartitions() < parts
    assert lines.filter("value like '%layers%'").select("value").groupBy(F.spark_partition_id()).count().count() == parts
    assert lines.filter("value like '%layers%'").count() == flat.count()


def test_a_run_from_packets_rebuilds_once_and_keeps_the_rebuild(spark, captures, made):
    from queries import packet_queries
    count, real = [], se.rebuild
    se.rebuild = lambda *a: count.append(1) or real(*a)
    try:
        packet_queries.report_issues_frames(spark, SF)
    finally:
        se.rebuild = real
    assert count == [1]
    behind = se.evidence_frames(spark, made[0].rebuilt)
    assert behind.count() == se.evidence_frames(spark, se.rebuild(ek.frames_from(ek.read_ek(spark, captures)))).count() > 0
