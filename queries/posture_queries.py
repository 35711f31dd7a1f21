"""Fusion, issue groups, scores, priorities and the whole assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import cross_queries, lifts
from queries.base import lit, query, values
from queries.cross_queries import CROSS
from queries.rule_queries import ALL_FINDINGS
from wirepost.functions import evidence as ev
from wirepost.functions import vocab
from wirepost.operators import cross, fusion, rules, scoring
from wirepost.plans import lineage

SEV = "CASE {c} WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END"
UNSEV = "CASE {c} WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END"
CERT = "CASE {c} WHEN 'UNDETERMINED' THEN 0 WHEN 'UNCERTAIN' THEN 1 WHEN 'PROBABLE' THEN 2 ELSE 3 END"
UNCERT = "CASE {c} WHEN 0 THEN 'UNDETERMINED' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'PROBABLE' ELSE 'CONFIRMED' END"
_TITLES = {r.rule_id: r.title for r in cross.DEFAULT_CROSS_RULES}
_XTITLE = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in _TITLES.items()) + " END"
U = f"""{ALL_FINDINGS}, {CROSS}, {values('dim_class', 'rid, issue_class, dimension', [(r, c, vocab.CLASS_DIMENSION[c]) for r, c in vocab.RULE_CLASS.items()])},
u AS (SELECT 'DETERMINISTIC' AS lane, finding_id, rule_id, capture_id, stream_key, protocol, status, severity, NULL AS deviation, conclusion, title, states, standards, seq FROM f
  UNION ALL SELECT 'CROSS_SESSION', finding_id, rule_id, capture_id, stream_key, protocol, status, severity, deviation, conclusion, {_XTITLE},
    CASE WHEN deviation = 'NOT_ASSESSED' OR rule_id = 'CS-STARTTLS-001' THEN adv_state WHEN rule_id = 'CS-STARTTLS-002' THEN tt_state || ',' || req_state ELSE ver_state END,
    CASE WHEN rule_id = 'CS-TLS-001' THEN 'NIST SP 800-52r2,RFC 8996 (BCP 195)' ELSE 'RFC 3207' END,
    100 + CASE rule_id WHEN 'CS-STARTTLS-001' THEN 0 WHEN 'CS-STARTTLS-002' THEN 1 ELSE 2 END FROM cf),
kl AS (SELECT u.*, issue_class, dimension, CASE WHEN status IN ('COMPLIANT', 'INFORMATIONAL') THEN 'POSITIVE_EVIDENCE'
    WHEN status IN ('AMBIGUOUS', 'INSUFFICIENT_EVIDENCE', 'NOT_OBSERVABLE') THEN 'ABSTENTION' WHEN lane = 'CROSS_SESSION' THEN 'BEHAVIOURAL_DEVIATION'
    ELSE 'BASE_SECURITY_ISSUE' END AS fact_kind FROM u JOIN dim_class ON rule_id = rid)"""
_HAS = "bool_or(contains(',' || states || ',', ',{s},'))"
_HASX = "(',' || states || ',') LIKE '%,{s},%'"
_CERTAINTY = """CASE WHEN amb THEN 'UNCERTAIN' WHEN inf THEN 'PROBABLE' WHEN obs THEN 'CONFIRMED' ELSE 'UNDETERMINED' END"""


def fused_cte(source: str, name: str, cls: str = "issue_class") -> str:
    return f"""{name}0 AS (SELECT capture_id, {cls} AS issue_class, fact_kind, stream_key, min_by(title, seq) AS title, min_by(conclusion, seq) AS conclusion,
    min_by(status, seq) AS st0, min(dimension) AS dimension, min(protocol) AS protocol, max(CASE WHEN status = 'OBSERVED_ISSUE' THEN {SEV.format(c='severity')} END) AS ir,
    count(DISTINCT status) AS nst, count(*) AS source_count, {_HAS.format(s='AMBIGUOUS')} AS amb, {_HAS.format(s='INFERRED')} AS inf,
    {_HAS.format(s='OBSERVED')} AS obs, {_HAS.format(s='NOT_OBSERVABLE')} AS hid, string_agg(standards, ',') AS stds
  FROM {source} WHERE fact_kind <> 'ABSTENTION' GROUP BY ALL),
{name} AS (SELECT *, nst > 1 AS contradiction, CASE WHEN nst = 1 THEN st0 WHEN ir IS NOT NULL THEN 'OBSERVED_ISSUE' ELSE 'AMBIGUOUS' END AS status,
    CASE WHEN ir IS NOT NULL THEN {UNSEV.format(c='ir')} ELSE 'INFO' END AS severity,
    CASE WHEN nst > 1 AND {_CERTAINTY} = 'CONFIRMED' THEN 'UNCERTAIN' ELSE {_CERTAINTY} END AS certainty,
    CASE WHEN hid THEN 'PARTIALLY_OBSERVABLE' ELSE 'OBSERVABLE' END AS observability,
    (CASE WHEN nst = 1 THEN st0 WHEN ir IS NOT NULL THEN 'OBSERVED_ISSUE' ELSE '' END = 'OBSERVED_ISSUE' AND fact_kind IN ('BASE_SECURITY_ISSUE', 'BEHAVIOURAL_DEVIATION')) AS penalising,
    (SELECT string_agg(z, ',' ORDER BY z) FROM (SELECT DISTINCT unnest(string_split(stds, ',')) AS z)) AS standards FROM {name}0)"""


FU = fused_cte("kl", "fu")
_TEMPLATES = "(" + ", ".join(lit(c) for c in fusion.REMEDIATION) + ")"


def groups_cte(source: str, name: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT capture_id, {extra} issue_class, fact_kind, max({SEV.format(c='q.severity')}) AS sr, {UNSEV.format(c=f"max({SEV.format(c='q.severity')})")} AS severity,
    {UNCERT.format(c=f"min({CERT.format(c='q.certainty')})")} AS certainty, count(stream_key) AS recurrence, count(*) AS finding_count, bool_or(q.penalising) AS penalising,
    min(q.dimension) AS dimension, arg_min(q.title, (-({SEV.format(c='q.severity')}), coalesce(q.stream_key, 'None'))) AS title,
    nullif(arg_min(coalesce(q.stream_key, 'None'), (-({SEV.format(c='q.severity')}), -({CERT.format(c='q.certainty')}), coalesce(q.stream_key, 'None'))), 'None') AS representative,
    coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol), '') AS protocols,
    (bool_or(q.penalising) AND issue_class IN {_TEMPLATES}) AS actionable, list_sort(list_distinct(flatten(list(string_split(standards, ','))))) AS stds
  FROM {source} q GROUP BY {extra} capture_id, issue_class, fact_kind)"""


GR = groups_cte("fu", "gr")
COV = """cov0 AS (SELECT capture_id, stream_key, bool_or(fact_kind <> 'ABSTENTION') AS concluded, bool_or(fact_kind = 'ABSTENTION') AS abstained FROM kl GROUP BY 1, 2),
cov AS (SELECT s.capture_id, count(*) AS sessions_total, count(CASE WHEN concluded THEN 1 END) AS sessions_assessed,
    count(CASE WHEN NOT coalesce(concluded, false) AND abstained THEN 1 END) AS sessions_abstained,
    count(CASE WHEN concluded THEN 1 END) / CAST(count(*) AS DOUBLE) AS assessed_fraction
  FROM s LEFT JOIN cov0 USING (capture_id, stream_key) GROUP BY 1)"""
WEIGHT = "CASE severity WHEN 'LOW' THEN 3.0 WHEN 'MEDIUM' THEN 12.0 WHEN 'HIGH' THEN 28.0 WHEN 'CRITICAL' THEN 55.0 ELSE 0.0 END"
DAMP = "(CASE WHEN recurrence <= 1 THEN 1.0 ELSE least(2.0, 1.0 + log2(recurrence) / 4.0) END)"
MULT = {"F1-instance": "CAST(recurrence AS DOUBLE)", "F2-group-damped": DAMP,
        "F3-worst-dominant": f"{DAMP} * pow(0.5, row_number() OVER (PARTITION BY {{k}} ORDER BY {WEIGHT} DESC, recurrence DESC, issue_class, fact_kind) - 1)"}


def comp_cte(formula: str, groups: str = "gr", keys: str = "capture_id", name: str = "cp") -> str:
    return f"""{name} AS (SELECT {keys}, issue_class, fact_kind, severity, recurrence, CAST({WEIGHT} AS DOUBLE) AS base_weight, {MULT[formula].format(k=keys)} AS multiplier,
    CAST({WEIGHT} AS DOUBLE) * {MULT[formula].format(k=keys)} AS penalty FROM {groups} WHERE penalising)"""


BAND = "CASE WHEN assessed_fraction < 0.5 THEN 'INSUFFICIENT_EVIDENCE' WHEN v >= 90 THEN 'STRONG' WHEN v >= 75 THEN 'ADEQUATE' WHEN v >= 50 THEN 'WEAK' ELSE 'CRITICAL' END"


def score_cte(name: str, comp: str = "cp", cov: str = "cov", keys: str = "capture_id") -> str:
    return f"""{name} AS (SELECT *, {BAND} AS band FROM (SELECT {cov}.*, coalesce(tp, 0.0) AS total_penalty, coalesce(nc, 0) AS components,
    CASE WHEN sessions_assessed = 0 THEN 0.0 ELSE greatest(0.0, 100.0 - coalesce(tp, 0.0)) END AS v
  FROM {cov} LEFT JOIN (SELECT {keys}, sum(penalty) AS tp, count(*) AS nc FROM {comp} GROUP BY ALL) q USING ({keys})) w)"""


# ------------------------------------------------------------------------------ Spark inputs
def classified(spark, sf):
    """All findings of both lanes, classified."""
    s = lifts.sessions(spark, sf, with_certificates=True)
    det = rules.run_rules(s)
    crossed = cross.cross_findings(cross.cross_context(ev.lean(lifts.sessions(spark, sf), "basis")))
    return fusion.classify_findings(spark, fusion.union_findings(det, crossed))


def judged(spark, sf, *more):
    """The same, judged once for all that reads them: a table without wording and evidence, but with the
    columns in `more`."""
    return lineage.written(classified(spark, sf).select(*fusion.SLIM, *more))


def fused(spark, sf):
    return fusion.fuse(classified(spark, sf))


def groups(spark, sf):
    return fusion.issue_groups(fused(spark, sf))


def slim_groups(spark, sf):
    """The same groups without their titles."""
    return fusion.issue_groups(fusion.fuse_table(judged(spark, sf, "standards")))


def scored(spark, sf, formula=vocab.SELECTED_FORMULA):
    kl = judged(spark, sf)
    gr = fusion.issue_groups(fusion.fuse_table(kl))
    return scoring.posture_score(gr, fusion.coverage(lifts.sessions(spark, sf), kl), formula)


def names(col):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda c: c["standard"]))), ",")


# ---------------------------------------------------------------------------------- queries
@query("classify_findings", f"WITH {U} SELECT finding_id, rule_id, issue_class, dimension, fact_kind FROM kl")
def classify_findings(spark, sf):
    return classified(spark, sf).select("finding_id", "rule_id", "issue_class", "dimension", "fact_kind")


REASON = "CASE status WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS_EVIDENCE' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'INSUFFICIENT_CAPTURE' ELSE 'NOT_OBSERVABLE' END"


@query("abstentions", f"WITH {U} SELECT capture_id, {REASON} AS reason, issue_class, title AS what_could_not_be_concluded, conclusion AS why, rule_id, stream_key, protocol FROM kl WHERE fact_kind = 'ABSTENTION'")
def abstentions(spark, sf):
    return fusion.abstentions(classified(spark, sf)).drop("resolved_by", "frame_count")


_FCOLS = ["capture_id", "issue_class", "fact_kind", "stream_key", "title", "conclusion", "status", "severity", "certainty",
          "observability", "source_count", "contradiction", "penalising", "standards"]


@query("fuse", f"WITH {U}, {FU} SELECT {', '.join(_FCOLS)} FROM fu")
def fuse(spark, sf):
    return fused(spark, sf).withColumn("standards", names(F.col("citations"))).select(*_FCOLS)


@query("resolve_contradictions", f"WITH {U}, {fused_cte('kl', 'fd', 'dimension')} SELECT capture_id, issue_class, fact_kind, stream_key, status, severity, certainty, observability, source_count, contradiction, standards FROM fd")
def resolve_contradictions(spark, sf):
    """Fusing on the dimension instead of the class puts disagreeing rules into one fact."""
    kl = classified(spark, sf).withColumn("issue_class", F.col("dimension"))
    return fusion.fuse(kl).withColumn("standards", names(F.col("citations"))).select(
        "capture_id", "issue_class", "fact_kind", "stream_key", "status", "severity", "certainty", "observability",
        "source_count", "contradiction", "standards")


@query("source_relations", f"""WITH {U}, d AS (SELECT *, 1 AS copy FROM kl UNION ALL SELECT *, 2 FROM kl WHERE severity = 'HIGH')
  SELECT capture_id, issue_class, stream_key, rule_id, CASE WHEN row_number() OVER (PARTITION BY capture_id, issue_class, fact_kind, stream_key, rule_id ORDER BY lane, finding_id) > 1
    THEN 'duplicates' WHEN lane = 'DETERMINISTIC' THEN 'supports' WHEN fact_kind = 'BEHAVIOURAL_DEVIATION' THEN 'enriches' ELSE 'contextualizes' END AS relation
  FROM d WHERE fact_kind <> 'ABSTENTION'""")
def source_relations(spark, sf):
    twice = classified(spark, sf).withColumn("copy", F.explode(F.when(F.col("severity") == "HIGH", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return fusion.source_relations(twice).select("capture_id", "issue_class", "stream_key", "rule_id", "relation")


_ONE = f"CASE WHEN {_HASX.format(s='AMBIGUOUS')} THEN 'UNCERTAIN' WHEN {_HASX.format(s='INFERRED')} THEN 'PROBABLE' WHEN {_HASX.format(s='OBSERVED')} THEN 'CONFIRMED' ELSE 'UNDETERMINED' END"


@query("certainty", f"""WITH {U} SELECT finding_id, {_ONE} AS certainty, CASE WHEN status = 'NOT_OBSERVABLE' THEN 'NOT_OBSERVABLE'
  WHEN {_HASX.format(s='NOT_OBSERVABLE')} THEN 'PARTIALLY_OBSERVABLE' ELSE 'OBSERVABLE' END AS observability FROM kl""")
def certainty(spark, sf):
    return fusion.certainty(classified(spark, sf)).select("finding_id", "certainty", "observability")


@query("citations", f"WITH {U}, z AS (SELECT DISTINCT finding_id, unnest(string_split(standards, ',')) AS standard FROM kl) SELECT finding_id, standard FROM z")
def citations(spark, sf):
    return fusion.cited_standards(classified(spark, sf))


_GUIDE = {r.rule_id: r.guidance for r in rules.DEFAULT_RULES}
_REM = values("rem", "cls, observed, why, action, verification", [(c, *t) for c, t in fusion.REMEDIATION.items()])


@query("remediation", f"""WITH {U}, {FU}, {_REM}, {values('gd', 'rid2, guide', _GUIDE.items())},
  w AS (SELECT capture_id, issue_class AS ic, fact_kind AS fk, stream_key AS sk, min_by(rule_id, seq) AS rid FROM kl WHERE fact_kind <> 'ABSTENTION' GROUP BY ALL)
  SELECT fu.capture_id, issue_class, stream_key, observed, action || CASE WHEN coalesce(guide, '') = '' THEN '' ELSE ' Rule guidance: ' || guide END AS recommended_action,
    'session ' || stream_key || coalesce(' (' || protocol || ')', '') AS affected_scope
  FROM fu JOIN rem ON issue_class = cls JOIN w ON w.capture_id = fu.capture_id AND ic = issue_class AND fk = fact_kind AND sk = stream_key
  LEFT JOIN gd ON rid = rid2 WHERE status = 'OBSERVED_ISSUE'""")
def remediation(spark, sf):
    return fusion.remediation(spark, fused(spark, sf)).select(
        "capture_id", "issue_class", "stream_key", "observed", "recommended_action", "affected_scope")


@query("order_fused", f"""WITH {U}, {FU} SELECT capture_id, issue_class, fact_kind, stream_key, severity FROM fu
  ORDER BY {SEV.format(c='severity')} DESC, issue_class, fact_kind, stream_key""")
def order_fused(spark, sf):
    return fusion.order_fused(fused(spark, sf)).select("capture_id", "issue_class", "fact_kind", "stream_key", "severity")


_GCOLS = "capture_id, issue_class, fact_kind, severity, certainty, recurrence, finding_count, penalising, dimension, title, representative, protocols, actionable"


@query("issue_groups", f"WITH {U}, {FU}, {GR} SELECT {_GCOLS}, array_to_string(stds, ',') AS standards FROM gr")
def issue_groups(spark, sf):
    g = groups(spark, sf)
    return g.withColumn("standards", names(F.col("citations"))).withColumn("protocols", F.array_join("protocols", ",")) \
        .select(*_GCOLS.split(", "), "standards")


@query("abstention_summary", f"""WITH {U}, b AS (SELECT capture_id, {REASON} AS reason, issue_class, stream_key FROM kl WHERE fact_kind = 'ABSTENTION')
  SELECT capture_id, 'reason' AS axis, reason AS bucket, count(*) AS abstentions, count(DISTINCT stream_key) AS affected_sessions FROM b GROUP BY 1, 3
  UNION ALL SELECT capture_id, 'issue_class', issue_class, count(*), count(DISTINCT stream_key) FROM b GROUP BY 1, 3
  UNION ALL SELECT capture_id, 'total', 'all', count(*), count(DISTINCT stream_key) FROM b GROUP BY 1""")
def abstention_summary(spark, sf):
    return fusion.abstention_summary(fusion.abstentions(classified(spark, sf)))


_DIMS = sorted(set(vocab.CLASS_DIMENSION.values()))


@query("risk_summary", f"""WITH {U}, {FU}, {GR}, aff AS (SELECT capture_id, count(DISTINCT CASE WHEN penalising THEN stream_key END) AS affected_sessions,
    count(CASE WHEN fact_kind = 'POSITIVE_EVIDENCE' THEN 1 END) AS positive_evidence FROM fu GROUP BY 1)
  SELECT gr.capture_id, count(CASE WHEN penalising THEN 1 END) AS issue_groups, {UNSEV.format(c='max(CASE WHEN penalising THEN sr END)')} AS highest_severity,
    {', '.join(f"count(CASE WHEN penalising AND severity = '{s}' THEN 1 END) AS severity_{s.lower()}" for s in vocab.SEVERITIES)},
    {', '.join(f"count(CASE WHEN penalising AND dimension = '{d}' THEN 1 END) AS dimension_{d.lower()}" for d in _DIMS)},
    count(CASE WHEN fact_kind = 'BEHAVIOURAL_DEVIATION' THEN 1 END) AS behavioural_deviations, count(CASE WHEN fact_kind = 'ANOMALY_SIGNAL' THEN 1 END) AS anomaly_signals,
    max(affected_sessions) AS affected_sessions, max(positive_evidence) AS positive_evidence
  FROM gr JOIN aff USING (capture_id) GROUP BY 1""")
def risk_summary(spark, sf):
    fu = fusion.fuse_table(judged(spark, sf))
    return fusion.risk_summary(fusion.issue_groups(fu), fu)


_STATE_COLS = ["adv_state", "req_state", "acc_state", "tt_state", "ver_state", "cip_state", "pc_state", "auth_state"]
_OBS = ", ".join("sum(" + " + ".join(f"CASE WHEN {c} = '{w}' THEN 1 ELSE 0 END" for c in _STATE_COLS) + f") AS state_{w.lower()}"
                 for w in vocab.EVIDENCE_STATES)
_COMP = ", ".join(f"count(CASE WHEN completeness = '{c}' THEN 1 END) AS {c.lower()}" for c in ("COMPLETE", "INCOMPLETE", "TRUNCATED"))
_PROT = ", ".join(f"count(CASE WHEN protocol = '{p}' THEN 1 END) AS protocol_{p}" for p in ("smtp", "imap", "pop3"))


@query("coverage", f"""WITH {U}, {COV}, hist AS (SELECT capture_id, {_OBS}, {_COMP}, {_PROT}, count(CASE WHEN protocol IS NULL THEN 1 END) AS protocol_unidentified FROM s GROUP BY 1)
  SELECT cov.*, hist.* EXCLUDE (capture_id) FROM cov JOIN hist USING (capture_id)""")
def coverage(spark, sf):
    return fusion.coverage(lifts.sessions(spark, sf), classified(spark, sf))


def _score_query(name, formula):
    cols = "capture_id, issue_class, severity, recurrence, base_weight, round(multiplier, 4) AS recurrence_multiplier, round(penalty, 4) AS penalty"

    @query(name, f"WITH {U}, {FU}, {GR}, {comp_cte(formula)} SELECT {cols} FROM cp")
    def run(spark, sf):
        return scoring.score(groups(spark, sf), formula).select(
            "capture_id", "issue_class", "severity", "recurrence", "base_weight",
            F.round("recurrence_multiplier", 4).alias("recurrence_multiplier"), F.round("penalty", 4).alias("penalty"))


_score_query("score_instance", "F1-instance")
_score_query("score_group_damped", "F2-group-damped")
_score_query("score_worst_dominant", "F3-worst-dominant")
SCORE_SQL = f"WITH {U}, {FU}, {GR}, {COV}, {comp_cte('F2-group-damped')}, {score_cte('sc')}"


@query("posture_score", f"{SCORE_SQL} SELECT capture_id, round(v, 2) AS value, band, round(total_penalty, 4) AS total_penalty, components, sessions_total, sessions_assessed, round(assessed_fraction, 4) AS assessed_fraction FROM sc")
def posture_score(spark, sf):
    return scored(spark, sf).select(
        "capture_id", F.round("value", 2).alias("value"), "band", F.round("total_penalty", 4).alias("total_penalty"), "components",
        "sessions_total", "sessions_assessed", F.round("assessed_fraction", 4).alias("assessed_fraction"))


COVP = COV.replace("cov0", "covp0").replace("cov AS", "covp AS").replace("SELECT s.capture_id", "SELECT s.capture_id, s.protocol") \
    .replace("FROM s LEFT JOIN", "FROM (SELECT * FROM s WHERE protocol IS NOT NULL) s LEFT JOIN").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("FROM kl GROUP BY 1, 2", "FROM kl GROUP BY 1, 2")
PROTO_SQL = f"""WITH {U}, {FU}, fp AS (SELECT * FROM fu WHERE protocol IS NOT NULL), {groups_cte('fp', 'gp', 'protocol,')}, {COVP},
  {comp_cte('F2-group-damped', 'gp', 'capture_id, protocol', 'cpp')}, {score_cte('scp', 'cpp', 'covp', 'capture_id, protocol')},
  fc AS (SELECT capture_id, protocol, coalesce(string_agg(DISTINCT CASE WHEN penalising THEN issue_class END, ',' ORDER BY CASE WHEN penalising THEN issue_class END), '') AS issue_classes,
    string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions_assessed, max(CASE WHEN dimension = 'CERTIFICATE_TRUST' THEN dimension END) AS dimensions_not_observable FROM gp GROUP BY 1, 2),
  ab AS (SELECT capture_id, protocol, count(*) AS abstentions FROM kl WHERE fact_kind = 'ABSTENTION' GROUP BY 1, 2)"""


@query("protocol_posture", f"{PROTO_SQL} SELECT capture_id, protocol, sessions_total, round(v, 2) AS value, band, issue_classes, dimensions_assessed, dimensions_not_observable, abstentions FROM scp JOIN fc USING (capture_id, protocol) JOIN ab USING (capture_id, protocol)")
def protocol_posture(spark, sf):
    kl = judged(spark, sf)
    p = scoring.protocol_posture(lifts.sessions(spark, sf), kl, fusion.fuse_table(kl))
    return p.select("capture_id", "protocol", "sessions_total", F.round("value", 2).alias("value"), "band", "issue_classes",
                    "dimensions_assessed", "dimensions_not_observable", "abstentions")


PRI = f"""pri0 AS (SELECT *, CASE severity WHEN 'LOW' THEN 10.0 WHEN 'MEDIUM' THEN 40.0 WHEN 'HIGH' THEN 70.0 WHEN 'CRITICAL' THEN 100.0 ELSE 0.0 END
    + CASE certainty WHEN 'CONFIRMED' THEN 6.0 WHEN 'PROBABLE' THEN 3.0 WHEN 'UNCERTAIN' THEN 1.0 ELSE 0.0 END
    + CASE fact_kind WHEN 'BASE_SECURITY_ISSUE' THEN 5.0 ELSE 2.0 END + CASE WHEN recurrence <= 1 THEN 0.0 ELSE least(8.0, 2.0 * log2(recurrence)) END
    + CASE WHEN len(stds) > 0 THEN 3.0 ELSE 0.0 END + CASE WHEN actionable THEN 2.0 ELSE 0.0 END AS priority_score
  FROM gr WHERE fact_kind IN ('BASE_SECURITY_ISSUE', 'BEHAVIOURAL_DEVIATION')),
pri AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY priority_score DESC, issue_class, fact_kind) AS rank FROM pri0)"""


@query("prioritise", f"WITH {U}, {FU}, {GR}, {PRI} SELECT capture_id, rank, issue_class, fact_kind, severity, recurrence, round(priority_score, 4) AS priority_score, representative FROM pri")
def prioritise(spark, sf):
    return scoring.prioritise(groups(spark, sf)).select(
        "capture_id", "rank", "issue_class", "fact_kind", "severity", "recurrence", F.round("priority_score", 4).alias("priority_score"), "representative")


AID = """aid AS (SELECT capture_id, substr(sha256(capture_id || '|1.0' || string_agg('|' || issue_class || ':' || fact_kind || ':' || severity || ':' || CAST(recurrence AS VARCHAR), ''
    ORDER BY sr DESC, recurrence DESC, issue_class, fact_kind)), 1, 16) AS assessment_id FROM gr GROUP BY 1)"""


@query("assessment_id", f"WITH {U}, {FU}, {GR}, {AID} SELECT * FROM aid")
def assessment_id(spark, sf):
    return scoring.assessment_id(groups(spark, sf))


@query("standards_summary", f"""WITH {U}, {FU}, z AS (SELECT capture_id, unnest(string_split(standards, ',')) AS standard FROM fu)
  SELECT DISTINCT capture_id, standard, CASE standard WHEN 'RFC 8996 (BCP 195)' THEN 'SS4-5' WHEN 'NIST SP 800-52r2' THEN 'SS3.1' WHEN 'RFC 3207' THEN 'SS6'
    WHEN 'RFC 8314' THEN 'SS3' ELSE '' END AS sections FROM z""")
def standards_summary(spark, sf):
    return fusion.standards_summary(fused(spark, sf)).select("capture_id", "standard", "sections")


@query("remediation_summary", f"""WITH {U}, {FU}, {GR}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sr DESC, recurrence DESC, issue_class, fact_kind) AS position
    FROM gr WHERE actionable) SELECT capture_id, position, issue_class, fact_kind, severity, recurrence FROM r""")
def remediation_summary(spark, sf):
    return fusion.remediation_summary(groups(spark, sf)).select("capture_id", "position", "issue_class", "fact_kind", "severity", "recurrence")


PROV = """prov AS (SELECT q.*, m.* EXCLUDE (capture_id) FROM (SELECT capture_id, count(CASE WHEN lane = 'DETERMINISTIC' THEN 1 END) AS deterministic_findings,
    count(CASE WHEN lane = 'CROSS_SESSION' THEN 1 END) AS cross_session_findings, count(CASE WHEN fact_kind = 'ABSTENTION' THEN 1 END) AS abstentions,
    string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids FROM kl GROUP BY 1) q
  JOIN (SELECT capture_id, count(*) AS fused_findings, sum(source_count - 1) AS duplicate_sources_merged, count(CASE WHEN contradiction THEN 1 END) AS contradictions_recorded FROM fu GROUP BY 1) m USING (capture_id))"""


@query("provenance", f"WITH {U}, {FU}, {PROV} SELECT * FROM prov")
def provenance(spark, sf):
    kl = judged(spark, sf)
    return fusion.provenance(kl, fusion.fuse_table(kl))


_BANDS = ["STRONG", "ADEQUATE", "WEAK", "CRITICAL", "INSUFFICIENT_EVIDENCE"]
_REVIEW = " UNION ALL ".join(
    f"SELECT '{f}' AS formula_id, v, band FROM sc{i}" for i, f in enumerate(MULT))


@query("score_review", f"""WITH {U}, {FU}, {GR}, {COV}, {', '.join(comp_cte(f, name=f'cp{i}') + ', ' + score_cte(f'sc{i}', f'cp{i}') for i, f in enumerate(MULT))}, al AS ({_REVIEW})
  SELECT formula_id, count(*) AS captures, round(avg(v), 2) AS mean, round(median(v), 2) AS median, round(min(v), 2) AS min, round(max(v), 2) AS max,
    count(CASE WHEN v = 0 THEN 1 END) AS at_zero, count(CASE WHEN v = 100 THEN 1 END) AS at_hundred, count(DISTINCT round(v, 2)) AS distinct_values,
    {', '.join(f"count(CASE WHEN band = '{b}' THEN 1 END) AS band_{b.lower()}" for b in _BANDS)} FROM al GROUP BY 1""")
def score_review(spark, sf):
    kl = classified(spark, sf)
    return scoring.score_review(fusion.issue_groups(fusion.fuse(kl)), fusion.coverage(lifts.sessions(spark, sf), kl))


# the first slice: three rule families, no history
_SLICE = ["SEC-TLS-001", "SEC-PLAIN-001", "SEC-PLAIN-002", "SEC-STLS-001"]
_SLICE_SQL = f"""{U}, ks AS (SELECT * FROM kl WHERE rule_id IN ({', '.join(lit(r) for r in _SLICE)})), {fused_cte('ks', 'fs2')}, {groups_cte('fs2', 'gs')},
  {COV.replace('cov', 'cvs').replace('FROM kl', 'FROM ks')}, {comp_cte('F2-group-damped', 'gs', name='cps')}, {score_cte('scs', 'cps', 'cvs')}"""


@query("posture_score_core_rules", f"WITH {_SLICE_SQL} SELECT capture_id, round(v, 2) AS value, band, components, sessions_assessed FROM scs")
def posture_score_core_rules(spark, sf):
    s = lifts.sessions(spark, sf)
    det = rules.run_rules(s, [rules.rule(r) for r in _SLICE])
    kl = fusion.classify_findings(spark, fusion.union_findings(det))
    sc = scoring.posture_score(fusion.issue_groups(fusion.fuse(kl)), fusion.coverage(s, kl))
    return sc.select("capture_id", F.round("value", 2).alias("value"), "band", "components", "sessions_assessed")
