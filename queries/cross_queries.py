"""Cross-session comparison and the downgrade detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import lifts
from queries.base import S, query
from wirepost.operators import cross, detectors

KEY = "capture_id, client_ip, server_ip, server_port, protocol, implicit_tls"
END = "capture_id, server_ip, server_port, protocol, implicit_tls"
ORD = "coalesce(start_epoch, -1e300), first_frame, tcp_stream_id"
VERSIONS = "('SSL2.0', 'SSL3.0', 'TLS1.0', 'TLS1.1', 'TLS1.2', 'TLS1.3')"
A = f"""a AS (SELECT *, CASE WHEN protocol IS NULL THEN 'NOT_COMPARABLE' WHEN client_ip IS NULL THEN 'INSUFFICIENT_EVIDENCE'
    WHEN completeness = 'TRUNCATED' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPARABLE' END AS comparability,
    coalesce(adv_value, adv_state) AS f_adv, coalesce(req_value, req_state) AS f_req,
    CASE WHEN tls_state = 'ESTABLISHED' THEN 'true' ELSE tls_state END AS f_est,
    coalesce(ver_value, ver_state) AS f_ver, coalesce(auth_value, auth_state) AS f_auth FROM s)"""
#: comparable sessions with their history, then all sessions with baseline and contrast
CONTEXT = f"""{A}, p AS (SELECT * FROM a WHERE comparability = 'COMPARABLE'),
h AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {ORD}) AS rn, count(*) OVER w AS n_prior,
    min(start_epoch) OVER w AS w0, max(start_epoch) OVER w AS w1, sum(CASE WHEN f_est = 'true' THEN 1 ELSE 0 END) OVER w AS ups,
    min(f_adv) OVER w AS adv0, max(f_adv) OVER w AS adv1, min(f_est) OVER w AS est0, max(f_est) OVER w AS est1,
    min(f_ver) OVER w AS ver0, max(f_ver) OVER w AS ver1
  FROM p WINDOW w AS (PARTITION BY {KEY} ORDER BY {ORD} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
pc AS (SELECT DISTINCT {KEY} FROM p),
ctl AS (SELECT m.capture_id, m.client_ip, m.server_ip, m.server_port, m.protocol, m.implicit_tls, o.tls_state,
    row_number() OVER (PARTITION BY m.capture_id, m.client_ip, m.server_ip, m.server_port, m.protocol, m.implicit_tls
      ORDER BY coalesce(o.start_epoch, -1e300) DESC, o.first_frame DESC, o.tcp_stream_id DESC) AS r
  FROM pc m JOIN p o ON m.capture_id = o.capture_id AND m.server_ip = o.server_ip AND m.server_port = o.server_port
    AND m.protocol = o.protocol AND m.implicit_tls = o.implicit_tls AND m.client_ip <> o.client_ip),
cc AS (SELECT {KEY}, count(*) AS n_ctl, count(CASE WHEN tls_state = 'ESTABLISHED' THEN 1 END) AS up_ctl
  FROM ctl WHERE r <= 50 GROUP BY ALL),
k AS (SELECT a.*, coalesce(h.n_prior, 0) AS prior_count, w0, w1, ups, adv0, adv1, est0, est1, ver0, ver1,
    CASE WHEN a.comparability = 'NOT_COMPARABLE' THEN 'NOT_APPLICABLE' WHEN coalesce(h.n_prior, 0) < 5 THEN 'INSUFFICIENT_HISTORY'
      ELSE 'ESTABLISHED' END AS baseline_status,
    CASE WHEN a.comparability = 'COMPARABLE' THEN coalesce(cc.n_ctl, 0) ELSE 0 END AS found, coalesce(cc.up_ctl, 0) AS found_up
  FROM a LEFT JOIN h ON a.stream_key = h.stream_key
  LEFT JOIN cc ON a.comparability = 'COMPARABLE' AND a.capture_id = cc.capture_id AND a.client_ip = cc.client_ip AND a.server_ip = cc.server_ip
    AND a.server_port = cc.server_port AND a.protocol = cc.protocol AND a.implicit_tls = cc.implicit_tls),
ctx AS (SELECT *, CASE WHEN implicit_tls OR found = 0 THEN 'CONTRAST_NOT_APPLICABLE' WHEN found_up > 0 AND found_up < found
    THEN 'CONTRAST_AMBIGUOUS' ELSE 'CONTRAST_SUPPORTED' END AS contrast_state,
    CASE WHEN implicit_tls OR found = 0 THEN 0 ELSE found END AS control_count,
    CASE WHEN NOT implicit_tls AND found > 0 THEN found_up / CAST(found AS DOUBLE) END AS control_rate,
    CASE WHEN NOT implicit_tls AND found > 0 THEN tls_state = 'ESTABLISHED' END AS subject_upgraded,
    (baseline_status = 'ESTABLISHED') AS usable FROM k)"""
RANK = "(CASE {c} WHEN 'SSL2.0' THEN 0 WHEN 'SSL3.0' THEN 1 WHEN 'TLS1.0' THEN 2 WHEN 'TLS1.1' THEN 3 WHEN 'TLS1.2' THEN 4 WHEN 'TLS1.3' THEN 5 END)"
_SUPPORTED = "(contrast_state = 'CONTRAST_SUPPORTED' AND control_rate = 1.0)"
_NOHIST = "'INSUFFICIENT_EVIDENCE' AS status, 'INFO' AS severity, 'NOT_ASSESSED' AS deviation, 'Insufficient comparable history to assess this session.' AS conclusion"
_BASE = "capture_id, tcp_stream_id, stream_key, protocol, adv_state, tt_state, req_state, ver_state"
_CASES = {
    "status": ["'INSUFFICIENT_EVIDENCE'", "'AMBIGUOUS'", "'OBSERVED_ISSUE'", "'COMPLIANT'", "'OBSERVED_ISSUE'", "'AMBIGUOUS'"],
    "severity": ["'INFO'", "'INFO'", "'MEDIUM'", "'INFO'", "'MEDIUM'", "'INFO'"],
    "deviation": ["'NOT_ASSESSED'", "'NOT_ASSESSED'", "'SUSPICIOUS_DEVIATION'", "'NONE'", "'SUSPICIOUS_DEVIATION'", "'DEVIATION'"],
    "conclusion": ["'Insufficient comparable history to assess this session.'", "'Historical advertisement behaviour is not consistent.'",
                   "'This endpoint consistently lacks the upgrade capability while comparable endpoints at the same server consistently have it.'",
                   "'Advertisement behaviour matches the established baseline.'",
                   "'This endpoint deviates from both its own history and from comparable endpoints that remain unaffected.'",
                   "'This session deviates from its own history; the cause is undetermined.'"],
}
_CONDS = ["NOT usable", "adv0 <> adv1", f"f_adv = adv0 AND {_SUPPORTED} AND NOT subject_upgraded AND f_adv <> 'true'", "f_adv = adv0",
          _SUPPORTED, "true"]
_ADV = ", ".join("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(_CONDS, vs)) + f" END AS {k}"
                 for k, vs in _CASES.items())
_OLD, _NEW = RANK.format(c="ver0"), RANK.format(c="ver_value")
CROSS = f"""{CONTEXT}, cf0 AS (
  SELECT 'CS-STARTTLS-001' AS rule_id, {_BASE}, {_ADV} FROM ctx WHERE NOT implicit_tls AND protocol IS NOT NULL
  UNION ALL SELECT 'CS-STARTTLS-002', {_BASE}, {_NOHIST} FROM ctx WHERE NOT implicit_tls AND protocol IS NOT NULL AND NOT usable
  UNION ALL SELECT 'CS-STARTTLS-002', {_BASE}, 'AMBIGUOUS', 'INFO', 'DEVIATION', 'Upgrade outcome differs from the established baseline.'
    FROM ctx WHERE NOT implicit_tls AND protocol IS NOT NULL AND usable AND est0 = est1 AND f_est <> est0
  UNION ALL SELECT 'CS-TLS-001', {_BASE}, CASE WHEN {_NEW} > {_OLD} THEN 'INFORMATIONAL' ELSE 'OBSERVED_ISSUE' END,
    CASE WHEN {_NEW} > {_OLD} THEN 'INFO' ELSE 'MEDIUM' END, CASE WHEN {_NEW} > {_OLD} THEN 'NONE' ELSE 'DEVIATION' END,
    'Negotiated version ' || CASE WHEN {_NEW} > {_OLD} THEN 'improved' ELSE 'regressed' END || ' from ' || ver0 || ' to ' || ver_value || '.'
    FROM ctx WHERE usable AND ver0 = ver1 AND ver_value <> ver0 AND ver0 IN {VERSIONS} AND ver_value IN {VERSIONS}),
cf AS (SELECT substr(sha256(rule_id || '|' || capture_id || '|' || coalesce(CAST(tcp_stream_id AS VARCHAR), 'None') || '|' || status || '|' || deviation), 1, 16)
    AS finding_id, * FROM cf0)"""
FINDING = ["finding_id", "rule_id", "capture_id", "stream_key", "status", "severity", "deviation", "conclusion"]


def context(spark, sf, dominant=False):
    return cross.cross_context(lifts.sessions(spark, sf), dominant=dominant)


@query("assess", f"WITH {S}, {A} SELECT stream_key, comparability FROM a")
def assess(spark, sf):
    return cross.assess(lifts.sessions(spark, sf)).select("stream_key", "comparability")


@query("population_index", f"""WITH {S}, {A}, p AS (SELECT * FROM a WHERE comparability = 'COMPARABLE')
  SELECT 'client' AS level, {KEY}, count(*) AS sessions, 1 AS clients FROM p GROUP BY ALL
  UNION ALL SELECT 'endpoint', capture_id, NULL, server_ip, server_port, protocol, implicit_tls, count(*), count(DISTINCT client_ip)
  FROM p GROUP BY ALL""")
def population_index(spark, sf):
    return cross.population_index(lifts.sessions(spark, sf))


@query("comparable_pairs", f"""WITH {S}, {A} SELECT x.stream_key AS a_key, y.stream_key AS b_key,
  CASE WHEN x.comparability <> 'COMPARABLE' THEN x.comparability WHEN y.comparability <> 'COMPARABLE' THEN y.comparability
    WHEN x.client_ip <> y.client_ip OR x.server_ip <> y.server_ip OR x.server_port <> y.server_port OR x.protocol <> y.protocol
      OR x.implicit_tls <> y.implicit_tls THEN 'NOT_COMPARABLE' ELSE 'COMPARABLE' END AS result
  FROM a x JOIN a y ON y.tcp_stream_id = x.tcp_stream_id + 1""")
def comparable_pairs(spark, sf):
    s = lifts.sessions(spark, sf)
    nxt = s.select((F.col("tcp_stream_id") - 1).alias("tcp_stream_id"), F.col("stream_key").alias("b_key"))
    pairs = s.select("tcp_stream_id", F.col("stream_key").alias("a_key")).join(nxt, "tcp_stream_id")
    return cross.comparable_pairs(pairs.select("a_key", "b_key"), s)


@query("prior_history", f"""WITH {S}, {CONTEXT} SELECT stream_key, n_prior AS prior_count, w0 AS window_start_epoch, w1 AS window_end_epoch FROM h""")
def prior_history(spark, sf):
    return cross.prior_history(lifts.sessions(spark, sf)).select(
        "stream_key", "prior_count", "window_start_epoch", "window_end_epoch")


_FEATS = "(VALUES ('starttls_advertised'), ('starttls_requested'), ('tls_established'), ('tls_version'), ('auth_activity')) q(feature)"


@query("feature_summary", f"""WITH {S}, {CONTEXT}, l AS (
    SELECT x.stream_key, x.n_prior, feature, CASE feature WHEN 'starttls_advertised' THEN y.f_adv WHEN 'starttls_requested' THEN y.f_req
      WHEN 'tls_established' THEN y.f_est WHEN 'tls_version' THEN y.f_ver ELSE y.f_auth END AS value
    FROM h x JOIN h y ON x.capture_id = y.capture_id AND x.client_ip = y.client_ip AND x.server_ip = y.server_ip AND x.server_port = y.server_port
      AND x.protocol = y.protocol AND x.implicit_tls = y.implicit_tls AND y.rn BETWEEN x.rn - 50 AND x.rn - 1 CROSS JOIN {_FEATS}),
  v AS (SELECT stream_key, n_prior, feature, value, count(*) AS n FROM l GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY stream_key, feature ORDER BY n DESC, value) AS rk FROM v)
  SELECT stream_key, feature, max(n_prior) AS total, count(*) AS distinct_values, max(CASE WHEN rk = 1 THEN value END) AS dominant,
    max(n) AS dominant_count, sum(CASE WHEN value = 'true' THEN n ELSE 0 END) AS true_count FROM r GROUP BY 1, 2""")
def feature_summary(spark, sf):
    return cross.feature_summary(lifts.sessions(spark, sf))


@query("build_baseline", f"""WITH {S}, {CONTEXT} SELECT stream_key, baseline_status, prior_count,
  CASE WHEN usable THEN round(ups / CAST(prior_count AS DOUBLE), 4) END AS rate,
  CASE WHEN usable AND adv0 = adv1 THEN adv0 END AS expected_adv, CASE WHEN usable AND est0 = est1 THEN est0 END AS expected_est,
  CASE WHEN usable AND ver0 = ver1 THEN ver0 END AS expected_ver, CASE WHEN usable THEN w0 END AS window_start_epoch,
  CASE WHEN usable THEN w1 END AS window_end_epoch FROM ctx""")
def build_baseline(spark, sf):
    b = cross.build_baseline(lifts.sessions(spark, sf))
    return b.select("stream_key", "baseline_status", "prior_count", F.round("baseline_rate", 4).alias("rate"),
                    F.col("expected_starttls_advertised").alias("expected_adv"),
                    F.col("expected_tls_established").alias("expected_est"),
                    F.col("expected_tls_version").alias("expected_ver"),
                    "window_start_epoch", "window_end_epoch")


@query("baseline_members", f"""WITH {S}, {CONTEXT} SELECT x.stream_key AS subject, y.stream_key AS member, y.start_epoch AS member_epoch
  FROM h x JOIN h y ON x.capture_id = y.capture_id AND x.client_ip = y.client_ip AND x.server_ip = y.server_ip AND x.server_port = y.server_port
    AND x.protocol = y.protocol AND x.implicit_tls = y.implicit_tls AND y.rn BETWEEN x.rn - 50 AND x.rn - 1""")
def baseline_members(spark, sf):
    return cross.baseline_members(lifts.sessions(spark, sf))


@query("find_controls", f"WITH {S}, {CONTEXT} SELECT stream_key, found AS control_count, CASE WHEN found > 0 THEN found_up ELSE 0 END AS controls_upgraded FROM k")
def find_controls(spark, sf):
    return cross.find_controls(lifts.sessions(spark, sf)).select("stream_key", "control_count", "controls_upgraded")


@query("evaluate_contrast", f"WITH {S}, {CONTEXT} SELECT stream_key, contrast_state, control_count, round(control_rate, 6) AS control_rate, subject_upgraded FROM ctx")
def evaluate_contrast(spark, sf):
    return cross.evaluate_contrast(lifts.sessions(spark, sf)).select(
        "stream_key", "contrast_state", "control_count", F.round("control_rate", 6).alias("control_rate"),
        "subject_upgraded")


def _cross_rule(name, rule_id):
    cols = ", ".join(FINDING)

    @query(name, f"WITH {S}, {CROSS} SELECT {cols} FROM cf WHERE rule_id = '{rule_id}'")
    def run(spark, sf):
        picked = [r for r in cross.DEFAULT_CROSS_RULES if r.rule_id == rule_id]
        return cross.cross_findings(context(spark, sf), picked).select(*FINDING)


_cross_rule("cs_advert", "CS-STARTTLS-001")
_cross_rule("cs_upgrade", "CS-STARTTLS-002")
_cross_rule("cs_version", "CS-TLS-001")


@query("cross_findings", f"WITH {S}, {CROSS} SELECT {', '.join(FINDING)} FROM cf")
def cross_findings(spark, sf):
    return cross.cross_findings(context(spark, sf)).select(*FINDING)


@query("cross_report", f"""WITH {S}, {CROSS}, z AS (SELECT capture_id, count(*) AS sessions_analysed, count(CASE WHEN usable THEN 1 END) AS baselines_established,
    count(CASE WHEN NOT usable THEN 1 END) AS abstentions, round(count(CASE WHEN NOT usable THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS abstention_rate FROM ctx GROUP BY 1),
  y AS (SELECT capture_id, count(*) AS findings, count(CASE WHEN deviation = 'NONE' THEN 1 END) AS none, count(CASE WHEN deviation = 'DEVIATION' THEN 1 END) AS deviation,
    count(CASE WHEN deviation = 'SUSPICIOUS_DEVIATION' THEN 1 END) AS suspicious_deviation, count(CASE WHEN deviation = 'NOT_ASSESSED' THEN 1 END) AS not_assessed FROM cf GROUP BY 1)
  SELECT z.*, y.* EXCLUDE (capture_id) FROM z JOIN y USING (capture_id)""")
def cross_report(spark, sf):
    ctx = context(spark, sf)
    return cross.cross_report(ctx, cross.cross_findings(ctx))


# -------------------------------------------------------------------------------- detectors
def obs_sql(start: str) -> str:
    return f"""SELECT stream_key AS session_id, tcp_stream_id AS sid, coalesce(protocol, 'none') AS protocol, coalesce(client_ip, 'none') AS client,
  server_ip AS server, CAST(coalesce(start_epoch, 0) / 86400 AS BIGINT) AS day, coalesce(adv_value = 'true', false) AS advertised,
  coalesce(req_value = 'true', false) AS commanded, (tls_state = 'ESTABLISHED') AS tls_ok, (pc_value = 'true') AS plaintext,
  (completeness = 'TRUNCATED') AS truncated, (tcp_stream_id % 11 = 0) AS attack FROM {start}"""


OBS = f"{S}, o AS ({obs_sql('s')})"


def observations(spark, sf):
    lifts.flat_sessions(spark, sf).createOrReplaceTempView("flat_sessions")
    return spark.sql(obs_sql("flat_sessions"))


@query("detector_d1", f"""WITH {OBS} SELECT session_id, CASE WHEN truncated THEN 'UNKNOWN' WHEN advertised AND NOT tls_ok THEN 'SUSPECT_DOWNGRADE' ELSE 'BENIGN' END AS verdict FROM o""")
def detector_d1(spark, sf):
    return detectors.detector_d1(observations(spark, sf)).select("session_id", "verdict")


_M = """count(*) AS n, count(CASE WHEN advertised THEN 1 END) AS advertised, count(CASE WHEN commanded THEN 1 END) AS commanded,
  count(CASE WHEN tls_ok THEN 1 END) AS tls_ok, count(CASE WHEN plaintext THEN 1 END) AS plaintext,
  count(CASE WHEN commanded AND NOT tls_ok THEN 1 END) AS failed, count(CASE WHEN truncated THEN 1 END) AS truncated"""
STATS = f"""st AS (SELECT 'global' AS key, NULL AS client, NULL AS server, NULL AS protocol, {_M} FROM o
  UNION ALL SELECT 'server', NULL, server, NULL, {_M} FROM o GROUP BY server
  UNION ALL SELECT 'client', client, NULL, NULL, {_M} FROM o GROUP BY client
  UNION ALL SELECT 'pair', client, server, NULL, {_M} FROM o GROUP BY client, server
  UNION ALL SELECT 'pair+proto', client, server, protocol, {_M} FROM o GROUP BY client, server, protocol
  UNION ALL SELECT 'server+proto', NULL, server, protocol, {_M} FROM o GROUP BY server, protocol)"""
INFRA = f"""{STATS}, inf AS (SELECT *, CASE WHEN n - truncated < 5 THEN 'INSUFFICIENT_HISTORY' WHEN tls_ok = 0 THEN 'CONSISTENT_PLAINTEXT'
  WHEN tls_ok = n - truncated THEN 'CONSISTENT_TLS' ELSE 'MIXED' END AS state FROM st)"""


@query("population_stats", f"WITH {OBS}, {STATS} SELECT * FROM st")
def population_stats(spark, sf):
    return detectors.population_stats(observations(spark, sf))


@query("infra_state", f"WITH {OBS}, {INFRA} SELECT key, client, server, protocol, state FROM inf")
def infra_state(spark, sf):
    return detectors.infra_state(detectors.population_stats(observations(spark, sf))) \
        .select("key", "client", "server", "protocol", "state")


def _d2(key, on, contrast):
    up = "(SELECT max(tls_ok) FROM inf v WHERE v.key = 'server+proto' AND v.server = o.server AND v.protocol = o.protocol)" if contrast else "0"
    return f"""WITH {OBS}, {INFRA} SELECT o.session_id, i.state, CASE WHEN o.truncated THEN 'UNKNOWN' WHEN o.tls_ok THEN 'BENIGN'
    WHEN i.state = 'INSUFFICIENT_HISTORY' THEN i.state WHEN i.state = 'CONSISTENT_PLAINTEXT' AND {up} = 0 THEN 'BENIGN'
    ELSE 'SUSPECT_DOWNGRADE' END AS verdict FROM o JOIN inf i ON i.key = '{key}' AND {on}"""


_PP = "i.client = o.client AND i.server = o.server AND i.protocol = o.protocol"


@query("detector_d2", _d2("pair+proto", _PP, False))
def detector_d2(spark, sf):
    return detectors.detector_d2(observations(spark, sf)).select("session_id", "state", "verdict")


@query("detector_d2_contrast", _d2("pair+proto", _PP, True))
def detector_d2_contrast(spark, sf):
    return detectors.detector_d2(observations(spark, sf), contrast=True).select("session_id", "state", "verdict")


@query("detector_d2_client", _d2("client", "i.client = o.client", True))
def detector_d2_client(spark, sf):
    return detectors.detector_d2(observations(spark, sf), "client", contrast=True).select("session_id", "state", "verdict")


@query("detector_time", f"""WITH {OBS}, d AS (SELECT client, server, protocol, day, count(CASE WHEN NOT truncated THEN 1 END) AS n,
    count(CASE WHEN NOT truncated AND tls_ok THEN 1 END) AS up FROM o GROUP BY ALL),
  pr AS (SELECT x.client, x.server, x.protocol, x.day, coalesce(sum(y.n), 0) AS prior_n, coalesce(sum(y.up), 0) AS prior_up
    FROM d x LEFT JOIN d y ON x.client = y.client AND x.server = y.server AND x.protocol = y.protocol AND y.day < x.day GROUP BY ALL)
  SELECT session_id, prior_n, prior_up, CASE WHEN truncated THEN 'UNKNOWN' WHEN tls_ok THEN 'BENIGN' WHEN prior_n < 5 THEN 'INSUFFICIENT_HISTORY'
    WHEN prior_up = 0 THEN 'BENIGN' ELSE 'SUSPECT_DOWNGRADE' END AS verdict FROM o JOIN pr USING (client, server, protocol, day)""")
def detector_time(spark, sf):
    return detectors.detector_time(observations(spark, sf)).select("session_id", "prior_n", "prior_up", "verdict")


@query("endpoint_rates", f"""WITH {OBS} SELECT client, server, protocol, count(*) AS sessions, count(CASE WHEN tls_ok THEN 1 END) AS upgraded,
  round(count(CASE WHEN tls_ok THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS rate FROM o WHERE NOT truncated GROUP BY ALL""")
def endpoint_rates(spark, sf):
    return detectors.endpoint_rates(observations(spark, sf))
