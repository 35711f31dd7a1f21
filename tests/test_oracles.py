"""A spread of registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import harness

SF = f"{harness.TESTDATA}/sf0.001"
PICK = ["rule_configuration_checklist", "build_chain", "cross_findings", "find_controls", "detector_time",
        "fuse", "posture_score", "project_frames", "walk_states", "reassembled_advert", "encode", "fit_robust",
        "ranking_metrics", "audit_transitions", "timeline"]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    verdict, _ = harness.compare(spark, harness.duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 5
