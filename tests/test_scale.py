"""What keeps the work of the lanes in proportion to their input."""

from pyspark.sql import functions as F

from queries import lifts
from wirepost.functions import evidence as ev
from wirepost.operators import anomaly, cross, fusion, rules, skew
from wirepost.plans import assessment, lineage

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_explode_without_their_wording(spark):
    found = rules.run_rules(lifts.sessions(spark, SF), [rules.rule("SEC-TLS-001")])
    assert "Negotiated TLS version posture" not in plan(found.select("status"))
    one = found.filter("status = 'OBSERVED_ISSUE'").first()
    assert one.title == "Negotiated TLS version posture" and [r.field for r in one.evidence_refs] == ["tls_negotiated_version"]


def test_median_of_counted_values(spark):
    rows = [("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 4), ("b", 3.0, 1), ("b", 4.0, 1), ("b", float("inf"), 1), ("c", -1.0, 2), ("c", 2.0, 2)]
    counts = spark.createDataFrame(rows, "k string, x double, _c bigint")
    got = {r.k: r["median"] for r in skew.counted_median(counts, ["k"], "x").collect()}
    assert got == {"a": 1.5, "b": 4.0, "c": 0.5}


def test_few_rows_meet_a_large_key_in_parts(spark):
    many = spark.range(5000).select(F.lit("cap").alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([("cap", 7), ("other", 8)], "k string, w int")
    joined = skew.join_few(many, few, ["k"], "v")
    assert joined.filter("w = 7").count() == 5000 == joined.select("v").distinct().count()
    assert "_part" in plan(joined) and joined.columns == ["k", "v", "w"]


def test_fit_reads_the_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(parts):
        for p in parts:
            seen.add(p.num_rows)
            yield p
    long = spark.range(40).selectExpr("'cap' AS capture_id", "'x' AS column", "CAST(id % 4 AS DOUBLE) AS value")
    long = long.mapInArrow(note, long.schema)
    one = anomaly.fit_robust(long, ["capture_id"]).first()
    assert (one.med, round(one.scale, 6), one.constant, seen.value) == (1.5, round(1.4826, 6), False, 40)


def test_small_tables_are_copied_and_large_ones_are_not(spark):
    few = spark.range(5)
    assert "broadcast" in plan(spark.range(9).join(lineage.hinted(few, 5), "id"))
    assert "broadcast" not in plan(spark.range(9).join(lineage.hinted(few, 4), "id"))


def test_facts_are_counted_in_a_hash_table(spark):
    """A text among the aggregates would sort every finding."""
    rows = [("c", "FORWARD_SECRECY", "POSITIVE_EVIDENCE", "c:1", "DETERMINISTIC", "SEC-FS-001", "COMPLIANT", "INFO", "CRYPTO_CONFIGURATION", "smtp", 17),
            ("c", "FORWARD_SECRECY", "POSITIVE_EVIDENCE", "c:1", "DETERMINISTIC", "SEC-FS-001", "INFORMATIONAL", "INFO", "CRYPTO_CONFIGURATION", "smtp", 18)]
    facts = fusion.fuse(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fusion.SLIM[:-1]) + ", evidence_states int"))
    one = facts.first()
    assert (one.status, one.certainty, one.contradiction, one.source_count) == ("AMBIGUOUS", "PROBABLE", True, 2)
    few = facts.select(*fusion.FUSE_KEY, "status", "severity", "certainty", "dimension", "penalising")
    assert "SortAggregate" not in few._jdf.queryExecution().sparkPlan().toString()


def test_states_travel_as_bits(spark):
    s = lifts.sessions(spark, SF, crypto=True)
    for found in (rules.run_rules(s), cross.cross_findings(cross.cross_context(s))):
        bits = found.groupBy("evidence_states", ev.bits_of(F.col("evidence_refs")).alias("wanted")).count().collect()
        assert len(bits) > 1 and all(r.evidence_states == r.wanted for r in bits)


def test_a_slim_run_has_the_same_posture(spark):
    s = lifts.sessions(spark, SF, crypto=True).filter("tcp_stream_id < 40")
    whole, slim = assessment.run(spark, s), assessment.run(spark, s, slim=True)
    assert slim.classified.columns == fusion.SLIM and "evidence_refs" in whole.classified.columns
    assert sorted(map(tuple, slim.posture().collect())) == sorted(map(tuple, whole.posture().collect())) != []


def whole_findings(spark):
    """Findings with wording and evidence; streams 1 and none have facts of several sources."""
    ref = "array(named_struct('field', 'tls_forward_secrecy', 'observed_value', 'true', 'evidence_state', state, 'frame_lo', n, 'frame_hi', n, 'frame_n', 1L, 'provenance', 'observed'))"
    rows = [("c:1", "SEC-FS-001", "OBSERVED_ISSUE", "MEDIUM", 1, "OBSERVED"), ("c:1", "SEC-FS-001", "OBSERVED_ISSUE", "HIGH", 2, "AMBIGUOUS"),
            ("c:2", "SEC-FS-001", "OBSERVED_ISSUE", "MEDIUM", 3, "INFERRED"), ("c:3", "SEC-FS-001", "COMPLIANT", "INFO", 4, "NOT_OBSERVABLE"),
            (None, "SEC-FS-001", "COMPLIANT", "INFO", 5, "OBSERVED"), (None, "SEC-FS-001", "INFORMATIONAL", "INFO", 6, "OBSERVED"),
            ("c:4", "SEC-FS-001", "AMBIGUOUS", "INFO", 7, "AMBIGUOUS"), ("c:4", "SEC-KEX-001", "INFORMATIONAL", "INFO", 8, "OBSERVED")]
    made = spark.createDataFrame(rows, "stream_key string, rule_id string, status string, severity string, n long, state string").selectExpr(
        "'c' AS capture_id", "stream_key", "rule_id", "status", "severity", f"{ref} AS evidence_refs", "concat('f', n) AS finding_id", "concat('t', n) AS title",
        "concat('said ', n) AS conclusion", "IF(n = 3, null, array('RFC 3207 (x)', 'other', 'RFC 3207 (x)', ' ')) AS standards", "IF(n = 4, null, 'do') AS guidance",
        "CAST(n AS INT) AS seq", "IF(n = 8, null, n) AS tcp_stream_id", "IF(n = 3, null, 'smtp') AS protocol", "CAST(null AS STRING) AS deviation", "IF(n = 6, 'CROSS_SESSION', 'DETERMINISTIC') AS lane")
    return fusion.classify_findings(spark, made)


def test_findings_that_are_alone_do_not_travel(spark):
    found = lineage.written(whole_findings(spark))
    shared = lineage.written(fusion.shared_hashes(found))
    grouped, parted = fusion.fuse(found), fusion.fuse(found, shared)
    assert parted.columns == grouped.columns and shared.count() == 2
    in_order = lambda df: sorted(map(str, df.collect()))
    assert in_order(parted) == in_order(grouped) and sorted(r.source_count for r in parted.collect()) == [1, 1, 1, 2, 2]
    assert {r.stream_key: [s["relation"] for s in r.sources] for r in parted.collect() if r.source_count > 1} == {"c:1": ["supports", "duplicates"], None: ["contextualizes", "duplicates"]}


def test_a_run_groups_only_facts_of_several_sources(spark, monkeypatch):
    seen, real = [], fusion.fuse
    monkeypatch.setattr(fusion, "fuse", lambda found, shared=None: seen.append(shared) or real(found, shared))
    s = lifts.sessions(spark, SF, crypto=True).filter("tcp_stream_id < 40")
    once, twice = assessment.run(spark, s), assessment.run(spark, s.union(s.filter("tcp_stream_id < 20")))
    assert seen[0].count() == 0 < seen[1].count()
    assert once.facts.count() == twice.facts.count() and twice.facts.filter("source_count = 2").count() > 0
    monkeypatch.setattr(lineage, "is_few", lambda rows, most=2000: False)
    many = assessment.run(spark, s.union(s.filter("tcp_stream_id < 20")))
    assert seen[2] is None and sorted(map(str, many.facts.collect())) == sorted(map(str, twice.facts.collect()))
