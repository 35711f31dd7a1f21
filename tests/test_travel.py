"""What travels between tasks and is written: once, and no wider than it is read."""

import datetime
import re

from pyspark.sql import functions as F

from queries import lifts
from queries import posture_queries as pq
from wirepost.functions import casts
from wirepost.functions import evidence as ev
from wirepost.operators import cross, crypto, fusion, rules
from wirepost.plans import assessment, lineage

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def deals(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def rows(df):
    return sorted(map(str, df.collect()))


def test_certificates_are_dealt_once(spark):
    chains = crypto.chain_arrays(lifts.certificates(spark, SF), ["tcp_stream_id"])
    assert len(deals(chains)) == 1 and "l_orderkey" in deals(chains)[0]
    assert chains.selectExpr("exists(certificates, c -> c.idx <> array_position(transform(certificates, x -> x.idx), c.idx) - 1) AS bad").filter("bad").count() == 0


def test_only_the_seeds_of_a_session_travel_to_its_chain(spark):
    whole = lifts.sessions(spark, SF, with_certificates=True)
    apart = lifts.sessions(spark, SF, crypto=True)
    assert whole.columns == [c for c in whole.columns if c in apart.columns] and set(whole.columns) == set(apart.columns)
    bare = [c for c in apart.columns if c not in (*lifts.CHAIN, "tls_certificate_chain")]
    assert rows(whole.select(*bare)) == rows(apart.select(*bare)) and whole.filter("size(certificates) > 1").count() > 0


def test_outcomes_and_chains_are_worked_out_once(spark):
    s = lifts.sessions(spark, SF, crypto=True)
    for found in (rules.run_rules(s), cross.cross_findings(cross.cross_context(s))):
        assert "Filter (size(array(" not in optimized(found)
    assert not re.search(r"Filter \(?\(?size\(transform", optimized(pq.query.__globals__["QUERIES"]["build_chain"](spark, SF)))


def test_odd_dates_and_moduli(spark):
    def epoch(y, m, d, h=0, mi=0, s=0):
        return int((datetime.datetime(y, m, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)).timestamp())
    dates = {" 2024-02-31 25:61:61 (UTC)": epoch(2024, 2, 31, 25, 61, 61), "2024-12-01T00:00:00Z": epoch(2024, 12, 1), "1969-12-31 23:59:59": -1, "2024-13-01 00:00:00": None,
             "2024-01-32 00:00:00": None, "2024-1-01 00:00:00": None, "x2024-01-01 00:00:00": None, "2024-01-01": None, "": None, None: None}
    moduli = {"00:80:01": 16, "8": 4, "0f:ff": 12, ":1::2:": 9, "": None, "00:00": None, "0g": None, "123": None, "01:00:00": 17, None: None}
    df = spark.createDataFrame([*zip(dates, moduli, strict=True)], "d string, m string")
    got = df.select("d", "m", crypto.cert_epoch(F.col("d")).alias("e"), crypto.rsa_bits(F.col("m")).alias("b")).collect()
    assert {r.d: r.e for r in got} == dates and {r.m: r.b for r in got} == moduli


def test_a_key_of_any_length_has_the_same_history(spark):
    s = lifts.sessions(spark, SF)
    pop = cross.assess(s.union(s)).filter("comparability = 'COMPARABLE'")
    counted = lambda df: rows(df.groupBy("stream_key").agg(F.count(F.lit(1)).alias("n")))
    sizes = sorted(r["count"] for r in pop.groupBy(*cross.CLIENT_KEY).count().collect())
    whole, cut = cross.history_chunks(pop, 50), cross.history_chunks(pop, 50, long_key=sizes[len(sizes) // 2])
    assert counted(whole) == counted(cut) and whole.filter("_n > 0").count() == 0 < cut.filter("_n > 0").count() and cut.filter("_n = 0").count() > 0
    near = lambda df: rows(df.select("start_epoch", "first_frame", F.count(F.lit(1)).over(cross._history_window(50)).alias("n")))
    assert near(whole) == near(cut)


def test_sessions_do_not_travel_to_a_few_endpoints(spark):
    found = cross.find_controls(lifts.sessions(spark, SF))
    assert "rightHint=(strategy=broadcast)" in optimized(found) and not deals(found)


def test_states_come_along_as_a_number(spark):
    s = lifts.sessions(spark, SF, crypto=True)
    found = cross.cross_findings(cross.cross_context(s)).select(*fusion.FUSE_KEY[-1:], "evidence_states")
    assert "frame_lo" not in optimized(found).split("Window")[0] and rows(found) == rows(
        cross.cross_findings(cross.cross_context(s)).select("stream_key", ev.bits_of(F.col("evidence_refs")).alias("evidence_states")))


def findings(spark):
    """Stream 1 has two rules on a class and kind, stream 2 two kinds, streams 3 and none come twice, stream 4 has a class of its own."""
    made = [("c:1", "CS-STARTTLS-001", "OBSERVED_ISSUE"), ("c:1", "CS-STARTTLS-002", "OBSERVED_ISSUE"), ("c:2", "SEC-FS-001", "COMPLIANT"), ("c:2", "SEC-FS-001", "OBSERVED_ISSUE"),
            ("c:3", "SEC-FS-001", "COMPLIANT"), ("c:3", "SEC-FS-001", "COMPLIANT"), (None, "SEC-KEX-001", "COMPLIANT"), (None, "SEC-KEX-001", "INFORMATIONAL"),
            ("c:4", "LOCAL-1", "COMPLIANT"), ("c:4", "LOCAL-2", "OBSERVED_ISSUE"), ("c:5", "SEC-FS-001", "AMBIGUOUS"), ("c:5", "SEC-FS-001", "AMBIGUOUS")]
    df = spark.createDataFrame([(*r, "MEDIUM" if r[2] == "OBSERVED_ISSUE" else "INFO") for r in made], "stream_key string, rule_id string, status string, severity string")
    wide = df.selectExpr("*", "substr(coalesce(stream_key, 'c'), 1, 1) AS capture_id", "'smtp' AS protocol", "1 AS evidence_states", "IF(rule_id LIKE 'CS%', 'CROSS_SESSION', 'DETERMINISTIC') AS lane")
    return fusion.classify_findings(spark, wide).select(*fusion.SLIM)


def test_facts_of_a_table_equal_those_of_all_findings_grouped(spark):
    found = lineage.written(findings(spark))
    want, got = fusion.fuse(found), fusion.fuse_table(found)
    assert rows(got) == rows(want) and sorted(r.source_count for r in got.collect()) == [1, 1, 1, 1, 2, 2, 2]
    shared = fusion.shared_hashes(found)
    assert shared.count() == 3 and not [line for line in deals(shared) if "stream_key" in line]


def test_every_citation_of_a_finding_once(spark):
    made = [("00ff00ff00ff00ff", ["RFC 3207 (x)", "unheard of", "RFC 3207 (y)"]), ("00ff00ff00ff00ff", ["RFC 8996"]), ("ffffffffffffffff", ["NIST SP 800-52r2"]),
            ("no number", ["RFC 3207"]), ("no number", ["RFC 3207"]), (None, ["RFC 3207"]), ("0000000000000001", []), ("0000000000000002", [" "]), ("0000000000000003", None)]
    df = spark.createDataFrame(made, "finding_id string, standards array<string>")
    want = df.select("finding_id", F.explode(fusion.resolve_citations(F.col("standards"))).alias("c")).select("finding_id", "c.standard").distinct()
    got = fusion.cited_standards(df)
    assert rows(got) == rows(want) and got.count() == 6
    assert "_number" in deals(got)[0] and "finding_id" not in deals(got)[0]


def test_ids_as_numbers(spark):
    ids = ["0000000000000000", "00ab00000000ffff", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff"]
    df = spark.createDataFrame([(i,) for i in [*ids, "FFFFFFFFFFFFFFFF", "fff", "0000000000000000\n", None]], "i string").select("i", casts.id_number(F.col("i")).alias("n"))
    assert {r.i: r.t for r in df.select("i", casts.id_text(F.col("n")).alias("t")).collect()} == {i: i if i in ids else None for i in [*ids, "FFFFFFFFFFFFFFFF", "fff", "0000000000000000\n", None]}


def test_findings_of_a_session_travel_together(spark):
    found = findings(spark).withColumn("finding_id", F.col("rule_id"))
    got = fusion.source_relations(found)
    assert len(deals(got)) <= 1 and got.filter("relation = 'duplicates'").count() == 2


def test_a_record_run_writes_no_ids_and_no_facts(spark):
    s = lifts.sessions(spark, SF, with_certificates=True)
    made = assessment.run(spark, s)
    fresh = assessment.lanes(spark, s)
    assert made.classified.columns == fresh.columns and rows(made.classified.select("finding_id", "seq")) == rows(fresh.select("finding_id", "seq"))
    read = {f.rsplit("/", 2)[-2] for f in made.facts.inputFiles()}
    assert read == {"classified", "shared"} and rows(made.facts) == rows(fusion.fuse(fresh))


def test_lean_evidence_keeps_its_type(spark):
    s = lifts.sessions(spark, SF)
    bare = ev.lean(s, "basis", "frame_lo")
    assert [(f.name, f.dataType.simpleString()) for f in bare.schema] == [(f.name, f.dataType.simpleString()) for f in s.schema]
    assert bare.filter("auth_activity.basis IS NOT NULL OR auth_activity.frame_lo IS NOT NULL").count() == 0 < bare.filter("auth_activity.frame_hi IS NOT NULL").count()
