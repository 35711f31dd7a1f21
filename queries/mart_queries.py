"""Catalogue tables, report tables, streaming and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import cross_queries, lifts
from queries import posture_queries as pq
from queries.anomaly_queries import _LB, FT, LANE
from queries import rule_queries as rq
from queries.base import DIM_SIG, FR, S, lit, query, values  # noqa: F401
from queries.session_queries import SESSIONS  # noqa: F401
from wirepost.functions import casts, vocab
from wirepost.operators import anomaly, cross, fusion, marts, rules, scoring
from wirepost.plans import lineage
from wirepost.sources import catalog, ek
from wirepost.streaming import ingest

# -------------------------------------------------------------------------------- catalogue
_STATE = "CASE {k} % 9 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'VALIDATING' WHEN 2 THEN 'QUEUED' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'FINALIZING' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'CANCELLED' ELSE 'COMPLETED' END"
RUNS = f"""SELECT o_orderkey AS run_id, CAST(o_custkey % 50 AS STRING) AS capture_id, {_STATE.format(k='o_orderkey')} AS state, o_orderdate AS created_at, o_orderkey % 2 = 0 AS ai_enabled,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'F1-instance' ELSE 'F2-group-damped' END AS formula_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'a' || CAST(o_custkey AS STRING) END AS assessment_id,
  'upload-' || CAST(o_orderkey % 100 AS STRING) || '.pcap' AS source_filename FROM orders"""
EVENTS = f"""SELECT event_id, user_id AS run_id, {_STATE.format(k='event_id')} AS to_state,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_STATE.format(k='(event_id + 8)')} END AS from_state FROM events"""
ASSESS = """SELECT 'a' || CAST(c_custkey AS STRING) AS assessment_id, {sha} AS content_sha256, CASE WHEN c_acctbal > 5000 THEN 'STRONG' ELSE 'WEAK' END AS overall_posture, c_acctbal AS score_value FROM customer"""


def runs(spark, sf):
    lifts.register(spark, sf, "orders", "customer", "events")
    return spark.sql(RUNS)


def assessments(spark, sf):
    lifts.register(spark, sf, "customer")
    return spark.sql(ASSESS.format(sha="sha2(c_name, 256)"))


@query("content_hash", """SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': nullif(lang, 'de'), 'source': source, 'text': text}) AS VARCHAR)) AS h FROM documents""")
def content_hash(spark, sf):
    lifts.register(spark, sf, "documents")
    d = spark.table("documents").select("doc_id", "text", F.nullif("lang", F.lit("de")).alias("lang"), "source", F.col("n_chars").alias("run_id"))
    return d.select("doc_id", catalog.content_hash(d).alias("h"))


@query("upsert_assessments", """WITH n AS (SELECT o_orderkey, 'a' || CAST(o_custkey + o_orderkey % 2 * 700 AS VARCHAR) AS assessment_id, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'Customer#' || lpad(CAST(o_custkey + o_orderkey % 2 * 700 AS VARCHAR), 9, '0') END) AS h FROM orders)
  SELECT o_orderkey, CASE WHEN h = sha256(c_name) THEN 'replay' WHEN c_custkey IS NOT NULL OR several THEN 'conflict' ELSE 'insert' END AS action FROM (SELECT *, min(h) OVER w <> max(h) OVER w AS several FROM n WINDOW w AS (PARTITION BY assessment_id)) LEFT JOIN customer ON assessment_id = 'a' || CAST(c_custkey AS VARCHAR)""")
def upsert_assessments(spark, sf):
    lifts.register(spark, sf, "orders")
    new = spark.sql("""SELECT o_orderkey, concat('a', o_custkey + o_orderkey % 2 * 700) AS assessment_id, sha2(CASE WHEN o_orderkey % 5 = 0 THEN 'changed'
      ELSE concat('Customer#', lpad(CAST(o_custkey + o_orderkey % 2 * 700 AS STRING), 9, '0')) END, 256) AS content_sha256 FROM orders""")
    return catalog.upsert_assessments(new, assessments(spark, sf)).select("o_orderkey", "action")


@query("list_runs", f"""WITH r AS ({RUNS}), a AS ({ASSESS.format(sha='sha256(c_name)')}), k AS (SELECT * FROM r WHERE state = 'COMPLETED'),
  p AS (SELECT *, (SELECT count(*) FROM k) AS total FROM k ORDER BY created_at DESC, run_id DESC LIMIT 500 OFFSET 40) SELECT run_id, p.assessment_id, overall_posture, total FROM p LEFT JOIN a ON p.assessment_id = a.assessment_id""")
def list_runs(spark, sf):
    return catalog.list_runs(runs(spark, sf), assessments(spark, sf), state="COMPLETED", limit=500, offset=40) \
        .select("run_id", "assessment_id", "overall_posture", "total")


@query("first_completed_run", f"""WITH r AS ({RUNS}) SELECT capture_id, ai_enabled, formula_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, ai_enabled, formula_id ORDER BY created_at, run_id) AS n
  FROM r WHERE state = 'COMPLETED' AND assessment_id IS NOT NULL) q WHERE n = 1""")
def first_completed_run(spark, sf):
    return catalog.first_completed_run(runs(spark, sf)).select("capture_id", "ai_enabled", "formula_id", "run_id")


def run_events(spark, sf):
    lifts.register(spark, sf, "events")
    return spark.sql(EVENTS)


@query("audit_transitions", f"""WITH e AS ({EVENTS}), {values('ed', 'a, b', vocab.JOB_EDGES)}, t AS (SELECT *, lag(to_state) OVER (PARTITION BY run_id ORDER BY event_id) AS prev FROM e)
  SELECT event_id, from_state IS NULL OR EXISTS (SELECT 1 FROM ed WHERE a = from_state AND b = to_state) AS allowed, from_state IS NOT DISTINCT FROM prev AS contiguous FROM t""")
def audit_transitions(spark, sf):
    return catalog.audit_transitions(spark, run_events(spark, sf)).select("event_id", "allowed", "contiguous")


_INT = f"WITH e AS ({EVENTS}), l AS (SELECT run_id, max_by(to_state, event_id) AS state FROM e GROUP BY 1), i AS (SELECT * FROM l WHERE state IN ('CREATED', 'VALIDATING', 'QUEUED', 'RUNNING', 'FINALIZING'))"


@query("interrupted_runs", f"{_INT} SELECT * FROM i")
def interrupted_runs(spark, sf):
    return catalog.interrupted_runs(run_events(spark, sf))


@query("sweep_events", f"{_INT} SELECT run_id, 1 AS step, state AS from_state, 'RECOVERY_REQUIRED' AS to_state FROM i UNION ALL SELECT run_id, 2, 'RECOVERY_REQUIRED', 'FAILED' FROM i")
def sweep_events(spark, sf):
    return catalog.sweep_events(catalog.interrupted_runs(run_events(spark, sf)))


ARTIFACTS = "SELECT doc_id AS artifact_id, doc_id % 60 AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS kind, doc_id AS path, doc_id % 3 <> 0 AS current, n_chars AS created_at, {rec} AS sha256 FROM documents"
FILES = "SELECT doc_id AS path, {sha} AS sha256, n_chars AS size_bytes FROM documents WHERE doc_id % 17 <> 0"
_REC = "CASE WHEN doc_id % 13 = 0 THEN 'corrupt' ELSE {sha} END"
VERIFIED = f"""v AS (SELECT a.*, CASE WHEN f.path IS NULL THEN 'MISSING' WHEN f.sha256 = a.sha256 THEN 'OK' ELSE 'MISMATCH' END AS integrity
  FROM ({ARTIFACTS.format(rec=_REC.format(sha='sha256(text)'))}) a LEFT JOIN ({FILES.format(sha='sha256(text)')}) f ON a.path = f.path)"""


def verified(spark, sf):
    lifts.register(spark, sf, "documents")
    art = spark.sql(ARTIFACTS.format(rec=_REC.format(sha="sha2(text, 256)")))
    return catalog.verify_artifacts(art, spark.sql(FILES.format(sha="sha2(text, 256)")))


@query("verify_artifacts", f"WITH {VERIFIED} SELECT artifact_id, integrity FROM v")
def verify_artifacts(spark, sf):
    return verified(spark, sf).select("artifact_id", "integrity")


@query("usable_artifact", f"WITH {VERIFIED} SELECT run_id, kind, artifact_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY created_at DESC, artifact_id DESC) AS n FROM v WHERE integrity = 'OK' AND current) q WHERE n = 1")
def usable_artifact(spark, sf):
    return catalog.usable_artifact(verified(spark, sf))


@query("store_size", "SELECT count(*) AS files, sum(n_chars) AS bytes FROM documents")
def store_size(spark, sf):
    lifts.register(spark, sf, "documents")
    return catalog.store_size(spark.table("documents").withColumnRenamed("n_chars", "size_bytes"))


# ------------------------------------------------------------------------------ report tables
G = f"WITH {pq.U}, {pq.FU}, {pq.GR}"
ABX = f"abx AS (SELECT capture_id, {pq.REASON} AS reason, issue_class, stream_key, rule_id, protocol, conclusion FROM kl WHERE fact_kind = 'ABSTENTION')"


def label_sql(voc, c):
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in vocab.LABELS[voc].items()) + " END"


def human_sql(c):
    return f"upper(substr(replace({c}, '_', ' '), 1, 1)) || lower(substr(replace({c}, '_', ' '), 2))"


MARKER = "CASE severity " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in vocab.SEVERITY_MARKER.items()) + " END"


@query("distributions", f"""{G}, {ABX}, b AS (SELECT capture_id, 'severity' AS axis, severity AS bucket FROM gr WHERE penalising UNION ALL SELECT capture_id, 'dimension', dimension FROM gr WHERE penalising
    UNION ALL SELECT capture_id, 'fact_kind', fact_kind FROM gr UNION ALL SELECT capture_id, 'abstention_reason', reason FROM abx), n AS (SELECT capture_id, axis, bucket, count(*) AS value FROM b GROUP BY ALL)
  SELECT *, max(value) OVER (PARTITION BY capture_id, axis) AS peak FROM n""")
def distributions(spark, sf):
    kl = pq.classified(spark, sf)
    return marts.distributions(fusion.issue_groups(fusion.fuse(kl)), fusion.abstentions(kl)).drop("place")


@query("protocol_rows", f"{pq.PROTO_SQL} SELECT capture_id, protocol, sessions_total AS sessions, {label_sql('posture', 'band')} AS band_label, lower(band) AS band_tone, abstentions FROM scp JOIN ab USING (capture_id, protocol)")
def protocol_rows(spark, sf):
    kl = pq.judged(spark, sf)
    p = scoring.protocol_posture(lifts.sessions(spark, sf), kl, fusion.fuse_table(kl))
    return marts.protocol_rows(p).drop("band", "score_text")


FROWS = f"""fr2 AS (SELECT pri.capture_id, rank, pri.issue_class, pri.fact_kind, fu.severity, fu.certainty, fu.status, fu.observability, pri.dimension, fu.protocol FROM pri JOIN fu ON fu.capture_id = pri.capture_id AND fu.issue_class = pri.issue_class
  AND fu.fact_kind = pri.fact_kind AND fu.stream_key = pri.representative)"""


def frows(spark, sf):
    fu = lineage.written(pq.fused(spark, sf).drop("title", "conclusion", "rule_guidance", "tcp_stream_id", "sources"))
    return marts.finding_rows(scoring.prioritise(fusion.issue_groups(fu)), fu)


@query("finding_rows", f"{G}, {pq.PRI}, {FROWS} SELECT capture_id, rank, severity, {MARKER} AS severity_marker, certainty, observability, {label_sql('status', 'status')} AS status_label, {human_sql('issue_class')} AS issue_class_label, coalesce(protocol, '__unattributed__') AS protocol_key FROM fr2")
def finding_rows(spark, sf):
    return frows(spark, sf).select("capture_id", "rank", "severity", "severity_marker", "certainty", "observability", "status_label", "issue_class_label", "protocol_key")


_FAC = " UNION ALL ".join(f"SELECT capture_id, '{a}' AS axis, {c} AS bucket FROM fr2" for a, c in {
    **{n: n for n in ["severity", "status", "certainty", "observability", "fact_kind", "issue_class", "dimension"]}, "protocol": "coalesce(protocol, '__unattributed__')"}.items())


@query("facets", f"{G}, {pq.PRI}, {FROWS}, fa AS ({_FAC}) SELECT capture_id, axis, bucket, count(*) AS n FROM fa GROUP BY ALL")
def facets(spark, sf):
    return marts.facets(frows(spark, sf)).drop("place")


@query("labels", f"WITH {S} SELECT completeness AS code, {human_sql('completeness')} AS humanised, count(*) AS n FROM s GROUP BY 1, 2")
def labels(spark, sf):
    return lifts.flat_sessions(spark, sf).groupBy(F.col("completeness").alias("code"), casts.humanise(F.col("completeness")).alias("humanised")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("group_rows", f"{G} SELECT capture_id, {human_sql('issue_class')} AS issue_class_label, severity, {MARKER} AS marker, {label_sql('fact_kind', 'fact_kind')} AS fact_kind_label, {label_sql('dimension', 'dimension')} AS dimension_label, recurrence FROM gr")
def group_rows(spark, sf):
    return marts.group_rows(pq.groups(spark, sf)).drop("issue_class", "penalising")


@query("abstention_rows", f"WITH {pq.U}, {ABX} SELECT stream_key, rule_id, {label_sql('abstention_reason', 'reason')} AS reason_label, coalesce(protocol, '{vocab.UNATTRIBUTED_LABEL}') AS protocol_label FROM abx")
def abstention_rows(spark, sf):
    return marts.abstention_rows(fusion.abstentions(pq.classified(spark, sf))).select("stream_key", "rule_id", "reason_label", "protocol_label")


@query("report_summary", f"""{pq.SCORE_SQL}, g2 AS (SELECT capture_id, count(*) AS n, count(CASE WHEN penalising THEN 1 END) AS p, max(CASE WHEN penalising THEN sr END) AS w FROM gr GROUP BY 1), a2 AS (SELECT capture_id, count(*) AS abstentions FROM kl WHERE fact_kind = 'ABSTENTION' GROUP BY 1)
  SELECT sc.capture_id, {label_sql('posture', 'band')} AS posture, printf('%.1f%%', assessed_fraction * 100) || ' (' || CAST(sessions_assessed AS VARCHAR) || ' of ' || CAST(sessions_total AS VARCHAR) || ' sessions assessed)' AS coverage_text,
    CAST(n AS VARCHAR) || ' total · ' || CAST(p AS VARCHAR) || ' penalising the score' AS groups_text, {pq.UNSEV.format(c='w')} AS highest_severity, abstentions FROM sc JOIN g2 USING (capture_id) JOIN a2 USING (capture_id)""")
def report_summary(spark, sf):
    kl = pq.judged(spark, sf)
    gr, cov = fusion.issue_groups(fusion.fuse_table(kl)), fusion.coverage(lifts.sessions(spark, sf), kl)
    return marts.report_summary(scoring.posture_score(gr, cov), cov, gr, fusion.abstentions(kl)).drop("score_text")


@query("report_prioritised", f"{G}, {pq.PRI} SELECT capture_id, rank, {MARKER} || ' ' || severity AS severity, {human_sql('issue_class')} AS issue, recurrence AS sessions, count(*) OVER (PARTITION BY capture_id) AS of FROM pri")
def report_prioritised(spark, sf):
    return marts.report_prioritised(scoring.prioritise(pq.slim_groups(spark, sf))).drop("priority")


@query("report_issues", f"""{G}, {pq.PRI}, rp AS (SELECT capture_id, issue_class, min_by(representative, rank) AS representative FROM pri GROUP BY 1, 2)
  SELECT gr.capture_id, gr.issue_class, fact_kind, severity, recurrence, rp.representative FROM gr LEFT JOIN rp ON rp.capture_id = gr.capture_id AND rp.issue_class = gr.issue_class""")
def report_issues(spark, sf):
    g = pq.slim_groups(spark, sf)
    return marts.report_issues(g, scoring.prioritise(g)).select("capture_id", "issue_class", "fact_kind", "severity", "recurrence", "representative")


@query("frame_label", f"""WITH {S} SELECT stream_key, CASE WHEN packet_count = last_frame - first_frame + 1 AND packet_count > 1 THEN '#' || CAST(first_frame AS VARCHAR) || '–#' || CAST(last_frame AS VARCHAR)
   WHEN packet_count = 0 THEN '—' WHEN packet_count = 1 THEN '#' || CAST(first_frame AS VARCHAR) ELSE '#' || CAST(first_frame AS VARCHAR) || ' +' || CAST(packet_count - 1 AS VARCHAR) END AS label FROM s""")
def frame_label(spark, sf):
    s = lifts.flat_sessions(spark, sf)
    return s.select("stream_key", casts.frame_label(F.col("first_frame"), F.col("last_frame"), F.col("packet_count")).alias("label"))


_SIGNATURES = " UNION ALL ".join(f"SELECT capture_id, '{field}' AS field, {p}_state || '|' || coalesce({p}_value, '') AS sg FROM s" for field, (p, _) in lifts.FIELD_LAYOUT.items())


@query("evidence_matrix", f"""WITH {S}, l AS ({_SIGNATURES}),
  n AS (SELECT capture_id, field, sg, count(*) AS n FROM l GROUP BY ALL) SELECT capture_id, field, count(*) AS signatures, sum(n) AS sessions, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(sg, n) END AS majority, CASE WHEN max(n) * 2 > sum(n) THEN sum(n) - max(n) ELSE 0 END AS divergent FROM n GROUP BY 1, 2""")
def evidence_matrix(spark, sf):
    return marts.evidence_matrix(lifts.sessions(spark, sf))


@query("side_facts", f"""WITH {S} SELECT capture_id, client_ip, count(*) AS sessions, count(CASE WHEN adv_value = 'true' THEN 1 END) AS starttls, count(CASE WHEN tls_state <> 'NONE' THEN 1 END) AS tls,
  count(CASE WHEN auth_value = 'true' AND coalesce(adv_value, '') <> 'true' AND tls_state = 'NONE' THEN 1 END) AS plaintext_auth FROM s GROUP BY 1, 2""")
def side_facts(spark, sf):
    return marts.side_facts(lifts.sessions(spark, sf))


@query("state_chips", f"WITH {pq.U}, z AS (SELECT DISTINCT finding_id, capture_id, unnest(string_split(states, ',')) AS state FROM kl) SELECT capture_id, state, count(*) AS findings FROM z GROUP BY 1, 2")
def state_chips(spark, sf):
    return marts.state_chips(pq.classified(spark, sf))


@query("severity_counts", f"""{G}, lv AS (SELECT * FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO'), ('UNRATED')) q(level)), cs AS (SELECT DISTINCT capture_id FROM gr)
  SELECT cs.capture_id, level, count(gr.severity) AS n FROM cs CROSS JOIN lv LEFT JOIN gr ON gr.capture_id = cs.capture_id AND gr.severity = level GROUP BY 1, 2""")
def severity_counts(spark, sf):
    return marts.severity_counts(pq.groups(spark, sf))


@query("search", f"""WITH {pq.U}, r AS ({RUNS}), entries AS (SELECT 'Sessions' AS category, protocol || ' ' || coalesce(client_ip || ' ', '') || server_ip AS title, packet_count || ' packets' AS subtitle FROM s WHERE protocol IS NOT NULL
    UNION ALL SELECT 'Sessions', coalesce(client_ip || ' ', '') || server_ip, packet_count || ' packets' FROM s WHERE protocol IS NULL
    UNION ALL SELECT 'Findings', title, severity || ' · ' || rule_id FROM kl UNION ALL SELECT 'Analyses', source_filename, '' FROM r WHERE state = 'COMPLETED'),
  hits AS (SELECT 'p c1' AS text, * FROM entries WHERE contains(lower(title || ' ' || subtitle || ' ' || category), 'p c1')
    UNION ALL SELECT 'sec-tls', * FROM entries WHERE contains(lower(title || ' ' || subtitle || ' ' || category), 'sec-tls'))
  SELECT text, category, title, count(*) AS n FROM hits GROUP BY 1, 2, 3""")
def search(spark, sf):
    """One text that names sessions and one that names findings."""
    s, found = lifts.flat_sessions(spark, sf), pq.classified(spark, sf)
    done = runs(spark, sf).withColumn("overall_posture", F.lit(None).cast("string"))
    hits = [marts.search(text, found, s, done).withColumn("text", F.lit(text.strip().lower())) for text in (" P C1", "sec-TLS")]
    return hits[0].unionByName(hits[1]).groupBy("text", "category", "title").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- whole assessment
@query("assess_posture", f"""{pq.SCORE_SQL}, {pq.AID}, {pq.PROV} SELECT sc.capture_id, assessment_id, round(v, 2) AS value, band, sessions_assessed, fused_findings, duplicate_sources_merged, rule_ids
  FROM sc JOIN aid USING (capture_id) JOIN prov USING (capture_id)""")
def assess_posture(spark, sf):
    from wirepost.plans import assessment
    s = lifts.sessions(spark, sf, with_certificates=True)
    return assessment.assess(spark, s).select("capture_id", "assessment_id", F.round("value", 2).alias("value"), "band", "sessions_assessed", "fused_findings",
                                              "duplicate_sources_merged", "rule_ids")


@query("anomaly_facts", f"WITH {S}, {FT}, {LANE} SELECT capture_id, stream_key, 'ANOMALY' AS issue_class, 'ANOMALY_SIGNAL' AS fact_kind, 'INFO' AS severity, band AS ml_band FROM ab WHERE band = 'ANOMALOUS'")
def anomaly_facts(spark, sf):
    """Anomaly signals beside the facts; the score never moves."""
    ctx = cross.cross_context(lifts.sessions(spark, sf), dominant=True)
    return fusion.anomaly_facts(anomaly.anomaly_lane(ctx)).select("capture_id", "stream_key", "issue_class", "fact_kind", "severity", "ml_band")


@query("model_summary", f"WITH {S}, {FT}, {LANE} SELECT capture_id, count(*) AS results, count(score) AS scored, count(*) - count(score) AS abstained, round(max(threshold), 3) AS threshold, {_LB} FROM ab GROUP BY 1")
def model_summary(spark, sf):
    return fusion.model_summary(anomaly.anomaly_lane(cross.cross_context(lifts.sessions(spark, sf), dominant=True))).withColumn("threshold", F.round("threshold", 3))


# ------------------------------------------------------------------------------- streaming
@query("stream_frames", f"WITH {FR} SELECT app_protocol, count(*) AS frames FROM fr GROUP BY 1")
def stream_frames(spark, sf):
    """The packet lines written as files, read back as a stream."""
    base = lineage.scratch(spark, "stream")
    lifts.ek_lines(spark, sf).select("value").write.mode("overwrite").text(f"{base}/in")
    q = ingest.stream_frames(spark, f"{base}/in").writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt") \
        .trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("app_protocol").agg(F.count(F.lit(1)).alias("frames"))


@query("foreach_batch_upsert", f"""WITH a AS ({ASSESS.format(sha='sha256(c_name)')}), k AS (SELECT *, CAST(substr(assessment_id, 2) AS BIGINT) AS n FROM a)
  SELECT 'stored' AS part, overall_posture, count(*) AS assessments FROM k WHERE n % 3 <> 0 OR n % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT 'conflict', overall_posture, sum(CASE WHEN n % 3 <> 0 THEN 1 ELSE 2 END) FROM k WHERE n % 2 = 1 GROUP BY 1, 2""")
def foreach_batch_upsert(spark, sf):
    """First two thirds arrive, then all with every second one replayed or new, and every other one
    under another content: a conflict where stored, and where both contents of a new id arrive."""
    base = lineage.scratch(spark, "upsert")
    a = assessments(spark, sf)
    n = F.substr("assessment_id", F.lit(2)).cast("bigint")
    changed = a.filter(n % 2 == 1).withColumn("content_sha256", F.sha2("content_sha256", 256))
    again = a.filter((n % 2 == 0) | (n % 3 == 0)).unionByName(changed)
    for step, part in enumerate((a.filter(n % 3 != 0), again)):
        part.write.parquet(f"{base}/in{step}")
        store = ingest.AssessmentStore(f"{base}/store", f"in{step}")
        q = spark.readStream.schema(a.schema).parquet(f"{base}/in{step}").writeStream.foreachBatch(store.upsert) \
            .option("checkpointLocation", f"{base}/ckpt{step}").trigger(availableNow=True).start()
        q.awaitTermination()
    count = lambda part, at: store.read(spark, at, a.schema).groupBy(F.lit(part).alias("part"), "overall_posture").agg(F.count(F.lit(1)).alias("assessments"))
    return count("stored", "stored").unionByName(count("conflict", "conflicts"))


@query("write_assessments", f"{pq.SCORE_SQL} SELECT band, capture_id FROM sc")
def write_assessments(spark, sf):
    path = lineage.scratch(spark, "docs")
    catalog.write_assessments(pq.scored(spark, sf), path)
    return spark.read.text(path).select("band", F.get_json_object("value", "$.capture_id").alias("capture_id"))


@query("read_ek", f"WITH {FR} SELECT frame_number, src_ip, src_port, app_protocol FROM fr")
def read_ek(spark, sf):
    path = lineage.scratch(spark, "ek")
    lifts.ek_lines(spark, sf).select("value").write.text(path)
    return ek.frames_from(ek.read_ek(spark, path)).select("frame_number", "src_ip", "src_port", "app_protocol")


# --------------------------------------------------------------------------------- extensions
@query("custom_rule", f"WITH {S} SELECT stream_key, 'LOCAL-001' AS rule_id, 'OBSERVED_ISSUE' AS status, 'LOW' AS severity FROM s WHERE packet_count > 50")
def custom_rule(spark, sf):
    registry = rules.RuleRegistry(rules.BASE_RULES)
    registry.register(rules.Rule("LOCAL-001", "Long session", ["local policy"], ["tls_transition"], lambda: F.col("packet_count") > 50,
                                 lambda: [(rules.OTHERWISE, rules.ISSUE, "LOW", "The session is long.")]))
    return rules.run_rules(lifts.sessions(spark, sf, crypto=True), registry.rules).filter(F.col("rule_id") == "LOCAL-001") \
        .select("stream_key", "rule_id", "status", "severity")


_CFG = cross_queries.CONTEXT.replace("< 5 THEN 'INSUFFICIENT_HISTORY'", "< 12 THEN 'INSUFFICIENT_HISTORY'").replace("50 PRECEDING", "20 PRECEDING")


@query("custom_cross_config", f"WITH {S}, {_CFG} SELECT stream_key, baseline_status, prior_count FROM ctx")
def custom_cross_config(spark, sf):
    cfg = cross.CrossConfig(min_history=12, max_history=20)
    return cross.cross_context(lifts.sessions(spark, sf), cfg).select("stream_key", "baseline_status", "prior_count")
