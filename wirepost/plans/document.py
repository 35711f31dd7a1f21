"""The assessment of a capture as one nested record, and its identity.

What the record nests is bounded by the rule set: groups, priorities, penalties, protocols, standards
and remediation have at most a row per issue class and kind (or protocol, or standard).  Facts and
abstentions grow with the traffic; the record holds their counts by rule and the digest of all their
rows, and the rows themselves stay tables.  So the hash of the record covers every row, and no record
grows with its capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepost.functions import vocab
from wirepost.operators import fusion, scoring
from wirepost.plans.assessment import Assessment
from wirepost.sources import catalog

ENGINE_VERSION = "1"
LIMITATIONS = (
    "Only captured packets are judged; traffic outside the capture point is unknown.",
    "Nothing is decrypted: what an encrypted session carries stays unobserved.",
    "Certificates are read as sent. Their trust anchors, revocation and host names are not checked.",
    "A missing observation is neither a weakness nor its absence.",
    "Whether a recommended action was taken, or helped, cannot be seen from this capture.",
)
MODEL_LIMITATIONS = ("An anomaly says that a session is unlike its population; it changes the ranking only.",)


def listed(df: DataFrame, name: str, order: list[Column], fields: list[str | Column]) -> DataFrame:
    """The few rows of each capture as one ordered array of structs.  `order` must tell rows apart."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*fields).alias("row"))))
    return df.groupBy("capture_id").agg(F.transform(rows, lambda r: r["row"]).alias(name))


def record(df: DataFrame, name: str) -> DataFrame:
    """The one row of each capture as a struct."""
    return df.select("capture_id", F.struct(*[c for c in df.columns if c != "capture_id"]).alias(name))


def guidance(groups: DataFrame) -> DataFrame:
    """Remediation of the groups that penalise and have a template, worst first."""
    rows = [(cls, *texts) for cls, texts in fusion.REMEDIATION.items()]
    dim = vocab.inline(groups.sparkSession, rows, "issue_class string, observed string, why_it_matters string, "
                       "recommended_action string, verification string")
    standards = F.array_distinct(F.transform("citations", lambda c: c["standard"]))
    return fusion.remediation_summary(groups).join(F.broadcast(dim), "issue_class").withColumn("standards", standards)


def abstention_counts(abst: DataFrame) -> DataFrame:
    """Refusals by reason, rule and protocol: as many rows as the rules allow, however many sessions."""
    return abst.groupBy("capture_id", "reason", "issue_class", "rule_id", "protocol").agg(
        F.min("what_could_not_be_concluded").alias("what_could_not_be_concluded"), F.min("resolved_by").alias("resolved_by"),
        F.count(F.lit(1)).alias("abstentions"), F.countDistinct("stream_key").alias("sessions"))


def documents(made: Assessment, formula_id: str = vocab.SELECTED_FORMULA, run_id: str | None = None,
              generated_at: str | None = None, model: DataFrame | None = None) -> DataFrame:
    """One nested record per capture, with `content_sha256` over its canonical form.

    The hash leaves out `run_id` and `generated_at`, so another run over equal traffic is a replay.
    `model` has the results of the anomaly lane.  A capture without groups has empty lists, never null.
    """
    groups, kl, facts = made.groups, made.classified, made.facts
    abst = fusion.abstentions(kl)
    cov = fusion.coverage(made.sessions, kl)
    worst = [-F.col("severity_rank"), -F.col("recurrence"), F.col("issue_class"), F.col("fact_kind")]
    lists = [
        listed(groups, "issue_groups", worst, [
            "issue_class", "fact_kind", "severity", "certainty", "dimension", "title", "recurrence", "finding_count", "penalising",
            "actionable", "protocols", "representative", "citations"]),
        listed(scoring.prioritise(groups, ai=model is not None), "prioritised", [F.col("rank")], [
            "rank", "issue_class", "fact_kind", "severity", "recurrence", "priority_score", "representative"]),
        listed(scoring.score(groups, formula_id), "components", [F.col("place"), F.col("issue_class"), F.col("fact_kind")], [
            "issue_class", "fact_kind", "severity", "recurrence", "base_weight", "recurrence_multiplier", "penalty"]),
        listed(scoring.protocol_posture(made.sessions, kl, facts, formula_id), "protocol_posture", [F.col("protocol")], [
            "protocol", "sessions_total", "sessions_assessed", "value", "band", "issue_classes", "dimensions_assessed",
            "dimensions_not_observable", "abstentions"]),
        listed(fusion.standards_summary(facts), "standards_summary", [F.col("standard")], ["standard", "sections", "texts", "uses"]),
        listed(guidance(groups), "remediation_summary", [F.col("position")], [
            "position", "issue_class", "fact_kind", "severity", "recurrence", "observed", "why_it_matters", "recommended_action",
            "verification", "standards"]),
        listed(abstention_counts(abst), "abstentions", [F.col(c) for c in ("reason", "issue_class", "rule_id", "protocol")], [
            "reason", "issue_class", "rule_id", "protocol", "what_could_not_be_concluded", "resolved_by", "abstentions", "sessions"]),
    ]
    records = [
        record(scoring.posture_score(groups, cov, formula_id).drop("sessions_total", "sessions_assessed", "assessed_fraction"), "score"),
        record(cov, "coverage"), record(fusion.risk_summary(groups, facts), "risk_summary"),
        record(fusion.provenance(kl, facts), "provenance"), scoring.assessment_id(groups),
        record(catalog.table_digest(facts, ["capture_id"]), "fact_rows"),
        record(catalog.table_digest(abst, ["capture_id"]), "abstention_rows")]
    if model is not None:
        records.append(record(fusion.model_summary(model), "model_summary"))
    out = made.sessions.select("capture_id").distinct()
    for part in [*records, *lists]:
        out = out.join(part, "capture_id", "left")
    empty = {name: F.coalesce(name, F.array()) for part in lists for name in part.columns if name != "capture_id"}
    texts = (*LIMITATIONS, *MODEL_LIMITATIONS) if model is not None else LIMITATIONS
    out = out.withColumns({
        **empty, "run_id": F.lit(run_id).cast("string"), "generated_at": F.lit(generated_at).cast("string"),
        "overall_posture": F.coalesce("score.band", F.lit("INSUFFICIENT_EVIDENCE")), "ai_enabled": F.lit(model is not None),
        "versions": F.struct(F.lit(vocab.POSTURE_SCHEMA_VERSION).alias("schema"), F.lit(ENGINE_VERSION).alias("engine")),
        "limitations": F.array(*[F.lit(t) for t in texts])})
    return out.withColumn("content_sha256", catalog.content_hash(out))
