"""Score arithmetic, order independence, contradictions, controls and registries."""

import math

import pytest
from pyspark.sql import functions as F

from queries import lifts
from wirepost.operators import cross, fusion, rules, scoring
from wirepost.plans import assessment

SF = "/root/testdata/sf0.001"


def groups(spark, rows):
    df = spark.createDataFrame([("c", cls, "BASE_SECURITY_ISSUE", sev, n, True) for cls, sev, n in rows],
                               "capture_id string, issue_class string, fact_kind string, severity string, recurrence long, penalising boolean")
    return df


def cover(spark, total=10, assessed=10):
    return spark.createDataFrame([("c", total, assessed, assessed / total if total else 0.0)],
                                 "capture_id string, sessions_total long, sessions_assessed long, assessed_fraction double")


def test_golden_score(spark):
    g = groups(spark, [("A", "HIGH", 6), ("B", "MEDIUM", 6), ("C", "MEDIUM", 1)])
    row = scoring.posture_score(g, cover(spark)).first()
    m = min(2.0, 1 + math.log2(6) / 4)
    assert round(row["value"], 2) == round(100 - 28 * m - 12 * m - 12, 2) == 22.15
    assert row["band"] == "CRITICAL"


@pytest.mark.parametrize("assessed,band", [(0, "INSUFFICIENT_EVIDENCE"), (4, "INSUFFICIENT_EVIDENCE"), (5, "STRONG")])
def test_band_needs_coverage(spark, assessed, band):
    row = scoring.posture_score(groups(spark, []), cover(spark, 10, assessed)).first()
    assert row["band"] == band


def test_unknown_formula_and_duplicate_rule():
    with pytest.raises(ValueError):
        scoring.formula("nope")
    with pytest.raises(ValueError):
        rules.RuleRegistry([rules.BASE_RULES[0], rules.BASE_RULES[0]])


def test_input_order_and_ai_do_not_move_the_score(spark):
    s = lifts.sessions(spark, SF, with_certificates=True)
    cols = ["capture_id", "value", "band", "total_penalty"]
    plain = sorted(map(tuple, assessment.assess(spark, s).select(*cols).collect()))
    shuffled = sorted(map(tuple, assessment.assess(spark, s.repartition(5, "start_epoch")).select(*cols).collect()))
    assert plain == shuffled


def test_contrast_states_by_hand(spark):
    """No control at all, controls that never upgrade, and controls that all do."""
    def row(stream, client, server, state):
        ev = ("true", "OBSERVED", "b", "observed", None, None, 0)
        return ("c", stream, f"c:{stream}", "smtp", client, server, 587, False, "COMPLETE", float(stream), stream, state, ev, ev, ev, ev)
    e = "struct<value:string,state:string,basis:string,provenance:string,frame_lo:bigint,frame_hi:bigint,frame_n:bigint>"
    rows = [row(1, "a", "alone", "NONE"), row(2, "a", "never", "NONE"), row(3, "b", "never", "NONE"),
            row(4, "a", "always", "NONE"), row(5, "b", "always", "ESTABLISHED")]
    df = spark.createDataFrame(rows, "capture_id string, tcp_stream_id long, stream_key string, protocol string, client_ip string, server_ip string, "
                               "server_port int, implicit_tls boolean, completeness string, start_epoch double, first_frame long, tls_state string, "
                               f"starttls_advertised {e}, starttls_requested {e}, tls_negotiated_version {e}, auth_activity {e}")
    got = {r["tcp_stream_id"]: (r["contrast_state"], r["control_rate"]) for r in cross.evaluate_contrast(df).collect()}
    assert got[1] == ("CONTRAST_NOT_APPLICABLE", None)
    assert got[2] == ("CONTRAST_SUPPORTED", 0.0)
    assert got[4] == ("CONTRAST_SUPPORTED", 1.0)
    assert got[5] == ("CONTRAST_SUPPORTED", 0.0)


def test_invariants_catch_unfounded_severity(spark):
    f = rules.run_rules(lifts.sessions(spark, SF), [rules.rule("SEC-TLS-001")])
    assert rules.invariant_violations(f).count() == 0
    broken = f.withColumn("severity", F.lit("HIGH"))
    want = f.filter(F.col("status") != "OBSERVED_ISSUE").count()
    assert rules.invariant_violations(broken).count() == want > 0
    assert set(fusion.REMEDIATION) <= set(fusion.vocab.CLASS_DIMENSION)
