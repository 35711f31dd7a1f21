"""Crypto enrichment, the per-session rules and their evidence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import lifts
from queries.base import C, DIM_SIG, DIM_SUITE, S, X, XC, finding_sql, lit, query, values
from wirepost.functions import evidence as ev
from wirepost.functions import vocab
from wirepost.operators import crypto, rules

COLUMNS = ["finding_id", "rule_id", "capture_id", "stream_key", "protocol", "status", "severity",
           "conclusion"]
PICK = "SELECT " + ", ".join(COLUMNS) + " FROM f"
HAS_TLS, EXPLICIT = "tls_state <> 'NONE'", "NOT implicit_tls"
I, OK, INFO, AMB, NOEV, NOOBS = rules.ISSUE, rules.OK, rules.INFO, rules.AMB, rules.NOEV, rules.NOOBS


def t(text: str) -> str:
    return lit(text)


_vtext = "'The session negotiated ' || ver_value || "
ITEMS = [
    f"CASE WHEN ver_state <> 'OBSERVED' THEN 'N' WHEN ver_value IN ('SSL2.0', 'SSL3.0', 'TLS1.0', 'TLS1.1') THEN 'F' ELSE 'P' END",
    "CASE WHEN fs_state = 'UNKNOWN' THEN 'N' WHEN fs_state = 'AMBIGUOUS' THEN 'A' WHEN fs_value = 'true' THEN 'P' ELSE 'F' END",
    "CASE WHEN n_certs = 0 OR NOT any_sized THEN 'N' WHEN any_weak THEN 'F' ELSE 'P' END",
    "CASE WHEN n_certs = 0 THEN 'N' WHEN any_deprecated THEN 'F' WHEN NOT any_known THEN 'N' ELSE 'P' END",
    "CASE WHEN n_certs = 0 OR start_epoch IS NULL OR NOT any_dated THEN 'N' WHEN any_out THEN 'F' ELSE 'P' END",
    "CASE WHEN n_certs = 0 OR leaf_self IS NULL THEN 'N' WHEN leaf_self = 1 AND n_certs = 1 THEN 'F' ELSE 'P' END",
    "CASE WHEN tls_state = 'NONE' THEN 'F' ELSE 'P' END",
]
MARKS = " || ".join(f"({i})" for i in ITEMS)
FAILED, PASSED, UNSEEN = (f"(7 - length(replace({MARKS}, '{m}', '')))" for m in "FPN")

#: rule -> (query name, source relation, condition, ladder); written apart from the Spark rules
SPECS = {
    "SEC-TLS-001": ("rule_tls_version", "xc", HAS_TLS, [
        ("ver_state = 'UNKNOWN'", NOEV, "INFO", t("The negotiated TLS version could not be established from this capture.")),
        ("ver_state = 'AMBIGUOUS'", AMB, "INFO", t("A ServerHello was observed but its version value was not recognised.")),
        ("ver_value LIKE 'SSL%'", I, "CRITICAL", _vtext + "', a deprecated protocol version.'"),
        ("ver_value IN ('TLS1.0', 'TLS1.1')", I, "HIGH", _vtext + "', a deprecated protocol version.'"),
        ("ver_value IN ('TLS1.2', 'TLS1.3')", OK, "INFO", _vtext + "', which meets current guidance.'"),
        ("true", AMB, "INFO", "'Negotiated version ''' || ver_value || ''' is outside the evaluated set.'")]),
    "SEC-TLS-002": ("rule_handshake_completion", "xc", HAS_TLS, [
        ("tls_state = 'ESTABLISHED' AND NOT (tt_state = 'OBSERVED' AND coalesce(tt_value, '') = 'true')", AMB, "INFO",
         t("TLS state and its supporting evidence disagree.")),
        ("tls_state = 'ESTABLISHED'", OK, "INFO", t("TLS negotiation completed and encrypted application data was observed.")),
        ("tls_state LIKE '%HELLO_OBSERVED'", NOEV, "INFO", t("TLS negotiation was observed but completion is not established.")),
        ("true", NOEV, "INFO", t("TLS records were present but the handshake could not be reconstructed."))]),
    "SEC-TLS-003": ("rule_trust_boundary", "xc", HAS_TLS, [
        ("true", NOOBS, "INFO", t("Certificate trust and revocation were not evaluated."))]),
    "SEC-STLS-001": ("rule_upgrade_outcome", "xc", EXPLICIT + " AND coalesce(req_value, '') = 'true'", [
        ("acc_state = 'AMBIGUOUS'", AMB, "INFO", t("The server's response to the upgrade request was contradictory.")),
        ("acc_value = 'false'", I, "MEDIUM", t("The client requested an upgrade and the server refused it.")),
        ("acc_value = 'true' AND tls_state = 'ESTABLISHED'", OK, "INFO", t("The session successfully upgraded to TLS.")),
        ("acc_value = 'true'", NOEV, "INFO", t("The upgrade was accepted but completion was not established.")),
        ("true", NOEV, "INFO", t("An upgrade was requested but no server response was captured."))]),
    "SEC-STLS-002": ("rule_advertisement_posture", "xc", EXPLICIT, [
        ("adv_state = 'OBSERVED' AND adv_value = 'true' AND coalesce(req_value, '') <> 'true'", INFO, "INFO",
         t("The server advertised an upgrade capability that the client did not use.")),
        ("adv_state = 'AMBIGUOUS'", AMB, "INFO",
         t("No upgrade capability was advertised; stripping and genuine non-support cannot be distinguished.")),
        ("adv_state = 'UNKNOWN'", NOEV, "INFO", t("No capability response was captured for this session."))]),
    "SEC-STLS-003": ("rule_implicit_tls", "xc", "implicit_tls", [
        ("true", INFO, "INFO", t("The session used implicit TLS; no STARTTLS upgrade applies."))]),
    "SEC-PLAIN-001": ("rule_cleartext_auth", "xc", EXPLICIT + " AND coalesce(auth_value, '') = 'true'", [
        ("tls_state = 'NONE'", I, "HIGH",
         t("Authentication commands were exchanged in cleartext; no TLS protection was observed for this session.")),
        ("true", INFO, "INFO", t("Authentication activity was observed in the pre-TLS phase of the session."))]),
    "SEC-PLAIN-002": ("rule_plaintext_session", "xc",
                      EXPLICIT + " AND protocol IS NOT NULL AND tls_state = 'NONE' AND tt_state = 'OBSERVED' AND tt_value = 'false'", [
        ("true", I, "MEDIUM", t("The mail session carried no TLS protection."))]),
    "SEC-KEX-001": ("rule_key_exchange", "xc", HAS_TLS, [
        ("kex_state = 'UNKNOWN'", NOEV, "INFO", t("The key exchange mechanism could not be established.")),
        ("kex_state = 'AMBIGUOUS'", AMB, "INFO", t("The key exchange mechanism could not be identified.")),
        ("true", INFO, "INFO", "'Key exchange: ' || kex_value || '.'")]),
    "SEC-FS-001": ("rule_forward_secrecy", "xc", HAS_TLS, [
        ("fs_state = 'UNKNOWN'", NOEV, "INFO", t("Forward secrecy could not be assessed for this session.")),
        ("fs_state = 'AMBIGUOUS'", AMB, "INFO", t("Forward secrecy could not be determined.")),
        ("fs_value = 'true'", OK, "INFO", t("The session provides forward secrecy.")),
        ("true", I, "MEDIUM", t("The negotiated key exchange does not provide forward secrecy."))]),
    "SEC-CERT-001": ("rule_certificate_presence", "xc", HAS_TLS, [
        ("n_certs = 0", NOOBS, "INFO", t("No certificate was observable in this session.")),
        ("true", INFO, "INFO", "CAST(n_certs AS VARCHAR) || CASE WHEN n_certs = 1 THEN ' certificate' ELSE ' certificates' END || ' extracted from the cleartext handshake.'")]),
    "SEC-CERT-002": ("rule_certificate_validity", "xc", "n_certs > 0", [
        ("start_epoch IS NULL", NOEV, "INFO", t("Certificate validity could not be evaluated.")),
        ("any_out", I, "HIGH", t("A certificate was outside its validity period during this session.")),
        ("NOT any_dated", NOEV, "INFO", t("Certificate validity dates could not be read.")),
        ("true", OK, "INFO", t("All observed certificates were within their validity period."))]),
    "SEC-CERT-003": ("rule_key_strength", "xc", "n_certs > 0", [
        ("any_weak", I, "HIGH", t("A certificate uses an RSA key below the permitted length.")),
        ("NOT any_sized", NOEV, "INFO", t("Certificate key strength could not be determined.")),
        ("true", OK, "INFO", t("Observed certificate keys meet the minimum length."))]),
    "SEC-CERT-004": ("rule_signature_hash", "xc", "n_certs > 0", [
        ("any_deprecated", I, "HIGH", t("A certificate in the chain is signed with a deprecated hash.")),
        ("NOT any_known", NOEV, "INFO", t("Certificate signature algorithms could not be identified.")),
        ("true", OK, "INFO", t("Certificate signature algorithms are current."))]),
    "SEC-CERT-005": ("rule_chain_structure", "xc", "n_certs > 0", [
        ("n_certs = 1 AND leaf_self = 1", I, "MEDIUM", t("The server presented a single self-signed certificate.")),
        ("n_certs > 1 AND any_broken", AMB, "INFO", t("The presented chain does not link end to end.")),
        ("true", INFO, "INFO", t("Certificate chain structure analysed."))]),
    "SEC-CFG-001": ("rule_configuration_checklist", "xc", "true", [
        (f"{FAILED} > 0", INFO, "INFO", f"'Configuration checklist: ' || CAST({FAILED} AS VARCHAR) || ' item(s) failed.'"),
        ("true", OK, "INFO", f"'Configuration checklist: ' || CAST({PASSED} AS VARCHAR) || ' of 7 items passed.'")]),
}
_CHAIN = "CASE WHEN n_certs > 0 THEN 'OBSERVED' ELSE 'NOT_OBSERVABLE' END"
#: evidence states a rule consults, comma separated
STATES = {
    "SEC-TLS-001": "ver_state", "SEC-TLS-002": "tt_state", "SEC-TLS-003": f"ver_state || ',' || {_CHAIN}",
    "SEC-STLS-001": "req_state || ',' || acc_state || CASE WHEN acc_state = 'OBSERVED' AND acc_value = 'true' THEN ',' || tt_state ELSE '' END",
    "SEC-STLS-002": "adv_state || CASE WHEN adv_state = 'OBSERVED' AND adv_value = 'true' THEN ',' || req_state ELSE '' END",
    "SEC-STLS-003": "adv_state || ',' || tt_state", "SEC-PLAIN-001": "auth_state || ',' || tt_state",
    "SEC-PLAIN-002": "tt_state || ',' || adv_state", "SEC-KEX-001": "kex_state || ',' || grp_state || ',' || sn_state",
    "SEC-FS-001": "fs_state || ',' || kex_state || ',' || ver_state", "SEC-CERT-001": f"{_CHAIN} || ',' || ver_state",
    "SEC-CERT-002": _CHAIN, "SEC-CERT-003": _CHAIN, "SEC-CERT-004": _CHAIN, "SEC-CERT-005": _CHAIN,
    "SEC-CFG-001": f"ver_state || ',' || fs_state || ',' || {_CHAIN}",
}
ORDER = [r.rule_id for r in rules.DEFAULT_RULES]
TITLE = {r.rule_id: r.title for r in rules.DEFAULT_RULES}
#: every per-session finding; `seq` is the rule order
ALL_FINDINGS = f"{XC}, f AS (" + " UNION ALL ".join(
    f"SELECT *, {ORDER.index(r)} AS seq FROM (" + finding_sql(r, *SPECS[r][1:], STATES[r], TITLE[r]) + ")" for r in ORDER) + ")"


def _one(rule_id):
    def run(spark, sf):
        certs = rule_id.startswith(("SEC-CERT", "SEC-CFG"))
        s = lifts.sessions(spark, sf, crypto=True, with_certificates=certs)
        return rules.run_rules(s, [rules.rule(rule_id)]).select(*COLUMNS)
    return run


for _id, (_name, _src, _where, _ladder) in SPECS.items():
    query(_name, f"WITH {XC}, f AS ({finding_sql(_id, _src, _where, _ladder)}) {PICK}")(_one(_id))


def all_findings(spark, sf):
    s = lifts.sessions(spark, sf, crypto=True, with_certificates=True)
    return rules.run_rules(s)


@query("run_rules", f"WITH {ALL_FINDINGS} {PICK}")
def run_rules(spark, sf):
    return all_findings(spark, sf).select(*COLUMNS)


@query("finding_counts", f"""WITH {ALL_FINDINGS}
  SELECT capture_id, 'status' AS axis, status AS bucket, count(*) AS findings FROM f GROUP BY ALL
  UNION ALL SELECT capture_id, 'severity', severity, count(*) FROM f GROUP BY ALL""")
def finding_counts(spark, sf):
    return rules.finding_counts(all_findings(spark, sf))


@query("finding_invariants", f"""WITH {ALL_FINDINGS} SELECT rule_id, count(*) AS n FROM f
  WHERE status <> 'OBSERVED_ISSUE' AND severity <> 'INFO' GROUP BY 1""")
def finding_invariants(spark, sf):
    return rules.invariant_violations(all_findings(spark, sf)).groupBy("rule_id") \
        .agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------------- evidence
@query("validate_evidence", f"""WITH {S}, b AS (
  SELECT capture_id, tcp_stream_id, 'starttls_advertised' AS field, adv_state AS st, CASE WHEN packet_count % 7 = 0 THEN NULL ELSE adv_value END AS v FROM s
  UNION ALL SELECT capture_id, tcp_stream_id, 'tls_negotiated_version', CASE WHEN packet_count % 5 = 0 THEN 'UNKNOWN' ELSE ver_state END, ver_value FROM s)
  SELECT capture_id, tcp_stream_id, field, CASE WHEN st = 'OBSERVED' AND v IS NULL THEN 'observed without a value'
    ELSE 'value on a valueless state' END AS problem FROM b
  WHERE (st = 'OBSERVED' AND v IS NULL) OR (st IN ('UNKNOWN', 'NOT_OBSERVABLE') AND v IS NOT NULL)""")
def validate_evidence(spark, sf):
    """Evidence damaged on purpose, so the quarantine has something to hold."""
    s = lifts.sessions(spark, sf)
    n = F.col("packet_count")
    adv, ver = F.col("starttls_advertised"), F.col("tls_negotiated_version")
    s = s.withColumn("starttls_advertised", F.when(n % 7 == 0, adv.withField(
        "value", F.lit(None).cast("string"))).otherwise(adv))
    s = s.withColumn("tls_negotiated_version", F.when(
        n % 5 == 0, ver.withField("state", F.lit("UNKNOWN"))).otherwise(ver))
    return ev.validate_evidence(s, ["starttls_advertised", "tls_negotiated_version"]) \
        .select("capture_id", "tcp_stream_id", "field", "problem")


@query("evidence_readings", f"""WITH {S} SELECT stream_key,
  CASE WHEN adv_state IN ('OBSERVED', 'INFERRED') THEN adv_value END AS conclusive,
  coalesce(adv_value, adv_state) AS value_first,
  CASE WHEN adv_state = 'OBSERVED' AND adv_value IS NOT NULL THEN adv_value ELSE adv_state END AS state_first FROM s""")
def evidence_readings(spark, sf):
    f = "starttls_advertised"
    return lifts.sessions(spark, sf).select(
        "stream_key", ev.value_or(f).alias("conclusive"), ev.reading(f).alias("value_first"),
        ev.tri_state(f).alias("state_first"))


# ---------------------------------------------------------------------------------- crypto
@query("enrich_suite", f"""WITH {DIM_SUITE}, {S} SELECT stream_key, suite_code, suite_name, kex, auth, enc, mac, is_tls13, ephemeral
  FROM s LEFT JOIN dim_suite ON suite_code = code""")
def enrich_suite(spark, sf):
    s = lifts.flat_sessions(spark, sf).select("stream_key", "suite_code")
    return crypto.enrich_suite(spark, s).drop("suite_hex")


def _evidence_query(name, field, prefix):
    @query(name, f"WITH {X} SELECT stream_key, {prefix}_value AS value, {prefix}_state AS state FROM x")
    def run(spark, sf):
        return lifts.sessions(spark, sf, crypto=True).select(
            "stream_key", F.col(f"{field}.value"), F.col(f"{field}.state"))


_evidence_query("named_group", "tls_named_group", "grp")
_evidence_query("key_exchange", "tls_key_exchange", "kex")
_evidence_query("forward_secrecy", "tls_forward_secrecy", "fs")
_evidence_query("suite_name", "tls_cipher_suite_name", "sn")

# a certificate message as the dissector lists it: key identifiers are missing where the
# certificate has none, so some lists cannot be attributed
MODULUS = "CASE key_bits WHEN 1024 THEN '00:80:01' WHEN 2048 THEN '7f:01:02' WHEN 4096 THEN '00:01:ff' END"


@query("rsa_bits", f"""WITH {C}, m AS (SELECT tcp_stream_id, idx, {MODULUS} AS modulus FROM c),
  z AS (SELECT *, ltrim(replace(modulus, ':', ''), '0') AS hx FROM m)
  SELECT tcp_stream_id, idx, CAST((length(hx) - 1) * 4 + CASE WHEN substr(hx, 1, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 4
    WHEN substr(hx, 1, 1) IN ('4', '5', '6', '7') THEN 3 WHEN substr(hx, 1, 1) IN ('2', '3') THEN 2 ELSE 1 END AS INT) AS bits FROM z""")
def rsa_bits(spark, sf):
    c = lifts.certificates(spark, sf)
    return c.select("tcp_stream_id", "idx", crypto.rsa_bits(F.expr(MODULUS)).alias("bits"))


_STAMP = "substr(CAST(l_shipdate AS {s}), 1, 10) || CASE WHEN l_partkey % 11 = 0 THEN ' noon' ELSE ' 06:07:08 (UTC)' END"


@query("cert_epoch", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 <> 0
    THEN epoch(l_shipdate)::BIGINT + 6 * 3600 + 7 * 60 + 8 END AS at FROM lineitem""")
def cert_epoch(spark, sf):
    lifts.register(spark, sf, "lineitem")
    text = F.expr(_STAMP.format(s="STRING"))
    return spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                          crypto.cert_epoch(text).alias("at"))


@query("self_signed", f"WITH {C} SELECT tcp_stream_id, idx, CASE WHEN ski IS NOT NULL THEN ski = aki END AS self_signed FROM c")
def self_signed(spark, sf):
    return lifts.certificates(spark, sf).select(
        "tcp_stream_id", "idx", crypto.self_signed(F.col("ski"), F.col("aki")).alias("self_signed"))


@query("chain_links", f"""WITH {C}, l AS (SELECT tcp_stream_id, idx, aki, lead(ski) OVER w AS nski, lead(idx) OVER w AS nidx
    FROM c WINDOW w AS (PARTITION BY tcp_stream_id ORDER BY idx))
  SELECT tcp_stream_id, idx, coalesce(aki = nski, false) AS linked FROM l WHERE nidx IS NOT NULL""")
def chain_links(spark, sf):
    return crypto.chain_links(lifts.certificates(spark, sf), ["tcp_stream_id"])


@query("signature_hashes", f"""WITH {C}, {DIM_SIG} SELECT tcp_stream_id, count(sig_name) AS recognised,
    min_by(sig_hash, CASE WHEN deprecated THEN idx END) AS deprecated_hash FROM c LEFT JOIN dim_sig ON sig_oid = oid GROUP BY 1""")
def signature_hashes(spark, sf):
    return crypto.signature_hashes(spark, lifts.certificates(spark, sf), ["tcp_stream_id"])


_OIDS = [o for o, _ in vocab.oid_rows()] + ["1.2.3.4", ""]
_OID = f"CASE l_partkey % {len(_OIDS)} " + " ".join(f"WHEN {i} THEN {lit(o)}" for i, o in enumerate(_OIDS)) + " END"


@query("describe_oid", f"""WITH {values('d', 'oid, oid_name', vocab.oid_rows())}, l AS (SELECT {_OID} AS o FROM lineitem)
  SELECT o AS oid, coalesce(oid_name, CASE WHEN o <> '' THEN o END) AS oid_name, count(*) AS n FROM l LEFT JOIN d ON o = oid GROUP BY ALL""")
def describe_oid(spark, sf):
    lifts.register(spark, sf, "lineitem")
    df = spark.table("lineitem").select(F.expr(_OID).alias("oid"))
    return crypto.describe_oid(spark, df, "oid").groupBy("oid", "oid_name") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("build_chain", f"""WITH {C}, n AS (SELECT tcp_stream_id, count(*) AS n, count(ski) AS n_ski, count(key_bits) AS n_mod,
    count(not_before) AS n_dates FROM c GROUP BY 1)
  SELECT c.tcp_stream_id, idx, 'serial' || CAST(idx AS VARCHAR) AS serial,
    CASE WHEN n_ski = n THEN ski END AS ski, aki,
    CASE WHEN n_mod = n THEN CASE key_bits WHEN 1024 THEN 16 WHEN 2048 THEN 23 WHEN 4096 THEN 9 END END AS key_bits,
    CASE WHEN n_dates = n THEN not_before END AS not_before, CASE WHEN n_dates = n THEN not_after END AS not_after,
    CASE WHEN n_ski = n THEN ski = aki END AS self_signed,
    CASE WHEN n = 1 THEN 'a.example,b.example' END AS san,
    'distinguished names' || CASE WHEN n > 1 THEN '|subjectAltName entries' ELSE '' END AS unattributed
  FROM c JOIN n USING (tcp_stream_id)""")
def build_chain(spark, sf):
    c = lifts.certificates(spark, sf).withColumn("modulus", F.expr(MODULUS))
    def stamp(e):
        return F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd HH:mm:ss '(UTC)'")
    def listed(col):
        return F.transform(F.filter(F.sort_array(F.collect_list(F.struct("idx", col.alias("v")))),
                                    lambda r: r["v"].isNotNull()), lambda r: r["v"])
    dates = F.when(F.col("not_before").isNotNull(),
                   F.concat_ws("|", stamp(F.col("not_before")), stamp(F.col("not_after"))))
    raw = c.groupBy("tcp_stream_id").agg(
        listed(F.concat(F.lit("serial"), F.col("idx").cast("string"))).alias("serials"),
        listed(F.col("ski")).alias("subject_key_ids"), listed(F.col("aki")).alias("authority_key_ids"),
        listed(F.col("modulus")).alias("rsa_moduli"), listed(F.col("sig_oid")).alias("algorithm_ids"),
        F.flatten(F.transform(listed(dates), lambda d: F.split(d, "[|]"))).alias("validity_utc"))
    names = ["serials", "subject_key_ids", "authority_key_ids", "rsa_moduli", "algorithm_ids",
             "validity_utc"]
    x509 = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names], F.lit("san_dns"), F.lit("dn_text")),
        F.array(*[F.col(n) for n in names], F.array(F.lit("a.example"), F.lit("b.example")),
                F.array(F.lit("Example"))))
    chain = crypto.build_chain(raw.select("tcp_stream_id", x509.alias("x509")))
    # an inner explode would have Spark build every chain once more below it, to see whether it is empty
    return chain.select("tcp_stream_id", "unattributed", F.explode_outer("certificates").alias("k")).filter(F.col("k").isNotNull()) \
        .select("tcp_stream_id", "k.idx", "k.serial", "k.ski", "k.aki", "k.key_bits",
                "k.not_before", "k.not_after", "k.self_signed",
                F.array_join("k.san", ",").alias("san"),
                F.array_join("unattributed", "|").alias("unattributed"))


@query("certificate_evidence", f"""WITH {XC} SELECT stream_key, CAST(CASE WHEN n_certs > 0 THEN n_certs END AS VARCHAR) AS value,
  CASE WHEN n_certs > 0 THEN 'OBSERVED' ELSE 'NOT_OBSERVABLE' END AS state FROM xc""")
def certificate_evidence(spark, sf):
    return lifts.sessions(spark, sf, with_certificates=True).select(
        "stream_key", "tls_certificate_chain.value", "tls_certificate_chain.state")
