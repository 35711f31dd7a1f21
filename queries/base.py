"""Registry of the named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries import lifts
from wirepost.functions import vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


S = f"s AS ({lifts.sessions_sql(lifts.Duck)})"
C = f"c AS ({lifts.certificates_sql(lifts.Duck)})"
FR = f"fr AS ({lifts.frames_sql(lifts.Duck)})"
DIM_SUITE = values("dim_suite", "code, suite_hex, suite_name, kex, auth, enc, mac, is_tls13, ephemeral",
                   vocab.suite_rows())
DIM_GROUP = values("dim_group", "gcode, group_name", vocab.NAMED_GROUPS.items())
DIM_SIG = values("dim_sig", "oid, sig_name, sig_key, sig_hash, deprecated",
                 [(o, *r, r[2] in vocab.DEPRECATED_HASHES) for o, r in vocab.SIGNATURE_OIDS.items()])
#: sessions with the derived crypto evidence
X = f"""{DIM_SUITE}, {DIM_GROUP}, {S}, x AS (
  SELECT s.*, suite_name, group_name,
    CASE WHEN suite_code IS NULL THEN NULL ELSE suite_name END AS sn_value,
    CASE WHEN suite_code IS NULL THEN 'UNKNOWN' WHEN suite_name IS NULL THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS sn_state,
    group_name AS grp_value,
    CASE WHEN group_code IS NULL THEN 'UNKNOWN' WHEN group_name IS NULL THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS grp_state,
    CASE WHEN t13 AND group_name IS NOT NULL THEN 'ECDHE (' || group_name || ')' WHEN t13 THEN 'ephemeral (EC)DHE'
         ELSE kex END AS kex_value,
    CASE WHEN t13 AND group_name IS NOT NULL THEN 'OBSERVED' WHEN t13 THEN 'INFERRED' WHEN suite_code IS NULL THEN 'UNKNOWN'
         WHEN kex IS NULL THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS kex_state,
    CASE WHEN t13 THEN 'true' WHEN ephemeral THEN 'true' WHEN NOT ephemeral THEN 'false' END AS fs_value,
    CASE WHEN t13 THEN 'INFERRED' WHEN suite_code IS NULL THEN 'UNKNOWN' WHEN ephemeral IS NULL THEN 'AMBIGUOUS'
         ELSE 'OBSERVED' END AS fs_state
  FROM (SELECT *, (ver_state = 'OBSERVED' AND ver_value = 'TLS1.3') AS t13 FROM s) s
  LEFT JOIN dim_suite ON suite_code = code LEFT JOIN dim_group ON group_code = gcode)"""
#: the same with one row of certificate facts per session
XC = f"""{X}, {C}, {DIM_SIG}, cl AS (
  SELECT c.*, sig_name, deprecated,
    CASE WHEN ski IS NOT NULL AND aki IS NOT NULL THEN ski = aki END AS self_signed,
    lead(ski) OVER (PARTITION BY tcp_stream_id ORDER BY idx) AS next_ski,
    lead(idx) OVER (PARTITION BY tcp_stream_id ORDER BY idx) AS next_idx
  FROM c LEFT JOIN dim_sig ON sig_oid = oid),
xc AS (
  SELECT x.*, coalesce(n, 0) AS n_certs, k.* EXCLUDE (sid, n) FROM x LEFT JOIN (
    SELECT x.tcp_stream_id AS sid, count(*) AS n,
      bool_or(not_before IS NOT NULL) AS any_dated,
      bool_or(coalesce(not_before IS NOT NULL AND (start_epoch > not_after OR start_epoch < not_before), false)) AS any_out,
      bool_or(key_bits IS NOT NULL) AS any_sized, bool_or(coalesce(key_bits < 2048, false)) AS any_weak,
      bool_or(sig_name IS NOT NULL) AS any_known, bool_or(coalesce(deprecated, false)) AS any_deprecated,
      bool_or(next_idx IS NOT NULL AND NOT coalesce(aki = next_ski, false)) AS any_broken,
      max(CASE WHEN idx = 0 AND self_signed IS NOT NULL THEN CAST(self_signed AS INT) END) AS leaf_self
    FROM x JOIN cl ON x.tcp_stream_id = cl.tcp_stream_id
    WHERE tls_state <> 'NONE' AND coalesce(ver_value, '') <> 'TLS1.3'
    GROUP BY 1) k ON x.tcp_stream_id = k.sid)"""


_UPGRADE = "CASE WHEN protocol = 'smtp' THEN 'RFC 3207' ELSE 'RFC 2595' END"
#: the registered standards each rule's citations resolve to, comma separated
STANDARDS = {
    "SEC-TLS-001": "'NIST SP 800-52r2,RFC 8996 (BCP 195)'", "SEC-TLS-002": "'UNMAPPED'", "SEC-TLS-003": "'UNMAPPED'",
    "SEC-STLS-001": _UPGRADE, "SEC-STLS-002": _UPGRADE, "SEC-STLS-003": "'RFC 8314'",
    "SEC-PLAIN-001": "'NIST SP 800-52r2,RFC 8314'", "SEC-PLAIN-002": "'NIST SP 800-52r2,RFC 8314'",
    "SEC-KEX-001": "'UNMAPPED'", "SEC-FS-001": "'NIST SP 800-52r2,UNMAPPED'", "SEC-CERT-001": "'UNMAPPED'",
    "SEC-CERT-002": "'UNMAPPED'", "SEC-CERT-003": "'UNMAPPED'", "SEC-CERT-004": "'UNMAPPED'", "SEC-CERT-005": "'UNMAPPED'",
    "SEC-CFG-001": "'NIST SP 800-52r2,RFC 8996 (BCP 195),UNMAPPED'",
}


def finding_sql(rule_id: str, source: str, applies: str, ladder, states: str = "''", title: str = "") -> str:
    """SELECT of one rule over `source`; the ladder holds (condition, status, severity, SQL text)."""
    def case(i):
        return "CASE " + " ".join(f"WHEN {row[0]} THEN {row[i]}" for row in ladder) + " END"
    quoted = [(c, lit(st), lit(sev), text) for c, st, sev, text in ladder]
    ladder = quoted
    return f"""SELECT substr(sha256('{rule_id}|' || capture_id || '|' || coalesce(CAST(tcp_stream_id AS VARCHAR), 'None')
    || '|' || status), 1, 16) AS finding_id, '{rule_id}' AS rule_id, capture_id, tcp_stream_id, stream_key, protocol, status, severity, conclusion, states, {lit(title)} AS title, standards
  FROM (SELECT capture_id, tcp_stream_id, stream_key, protocol, {case(1)} AS status, {case(2)} AS severity, {case(3)} AS conclusion, {states} AS states, {STANDARDS[rule_id]} AS standards
        FROM {source} WHERE {applies}) q WHERE status IS NOT NULL"""
