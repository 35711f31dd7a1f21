"""From packets or sessions to one assessment row per capture.

Every stage is a table of the run, written once: frames, sessions, classified findings, facts and
issue groups.  What follows a stage reads its table, so no lane is planned twice."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from wirepost.functions import evidence as ev
from wirepost.functions import vocab
from wirepost.operators import anomaly, cross, fusion, rules, scoring
from wirepost.operators import sessions as rebuild
from wirepost.plans import lineage


def lanes(spark: SparkSession, sessions: DataFrame, config: cross.CrossConfig | None = None,
          context: DataFrame | None = None) -> DataFrame:
    """Classified findings of the per-session and the cross-session rules."""
    config = config or cross.CrossConfig()
    # no finding shows the basis of its evidence, so it does not travel with the sessions
    context = cross.cross_context(ev.lean(sessions, "basis"), config) if context is None else context
    union = fusion.union_findings(rules.run_rules(sessions), cross.cross_findings(context, config.rules))
    return fusion.classify_findings(spark, union)


@dataclass(frozen=True)
class Assessment:
    """The tables of one run, and what is computed from them."""
    sessions: DataFrame
    classified: DataFrame
    facts: DataFrame
    groups: DataFrame
    #: the rebuild behind the sessions, where the run began with frames
    rebuilt: rebuild.Rebuilt | None = None

    def posture(self, formula_id: str = vocab.SELECTED_FORMULA) -> DataFrame:
        """Score, band, identity and provenance per capture."""
        score = scoring.posture_score(self.groups, fusion.coverage(self.sessions, self.classified), formula_id)
        return score.join(scoring.assessment_id(self.groups), "capture_id", "left") \
            .join(fusion.provenance(self.classified, self.facts), "capture_id", "left")


def run(spark: SparkSession, sessions: DataFrame, ai: bool = False, config: cross.CrossConfig | None = None,
        stages: lineage.Stages | None = None, slim: bool = False) -> Assessment:
    """All stages after the sessions.  With `ai` the anomaly lane joins the ranking; the score and the
    groups of the rules stay what they are.  A `slim` run writes its stages without wording and evidence:
    enough for `posture`, not for a record or a report.

    Where few facts have several sources, the others are their findings under other names.  They are then no
    table of their own: each reader makes what it needs of them from the findings.
    """
    stages = stages or lineage.Stages(spark, "assessment")
    sessions = stages.table("sessions", ev.lean(sessions, "basis", "provenance", "frame_lo", "frame_hi", "frame_n") if slim else sessions)
    findings = lanes(spark, sessions, config)
    # an id is a hash of other columns; as such it is nearly half of the table and is left out of it
    classified = stages.table("classified", findings.select(*fusion.SLIM) if slim else findings.drop("finding_id"))
    if not slim:
        classified = classified.withColumn("finding_id", fusion.own_id()).select(*findings.columns)
    shared = stages.table("shared", fusion.shared_hashes(classified))
    few = lineage.is_few(shared)
    facts = fusion.fuse(classified, shared if few else None)
    if ai:
        facts = fusion.attach_anomalies(facts, anomaly.anomaly_lane(cross.cross_context(sessions, dominant=True)))
    if ai or not few:
        facts = stages.table("facts", facts)
    return Assessment(sessions, classified, facts, stages.table("groups", fusion.issue_groups(facts)))


def assess(spark: SparkSession, sessions: DataFrame, formula_id: str = vocab.SELECTED_FORMULA,
           ai: bool = False) -> DataFrame:
    """Score, band, identity and provenance of sessions that are already rebuilt."""
    return run(spark, sessions, ai, slim=True).posture(formula_id)


def assess_packets(spark: SparkSession, frames: DataFrame, truncated_captures: DataFrame | None = None,
                   ai: bool = False, slim: bool = False) -> Assessment:
    """From the frames of any number of captures to their assessment; `slim` as in `run`.  The rebuild comes with
    it, for what follows the sessions back to their frames."""
    stages = lineage.Stages(spark, "assessment")
    frames = stages.table("frames", frames)
    parts = rebuild.rebuild(frames, truncated_captures)
    return replace(run(spark, rebuild.sessions_of(spark, parts), ai, stages=stages, slim=slim), rebuilt=parts)
