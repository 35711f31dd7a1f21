"""Per-session rules.

A rule is a filter and an outcome ladder over session columns.  `run_rules` evaluates any number
of rules in one pass over the sessions: each rule yields at most one outcome struct, and the
non-null ones are exploded into finding rows.  Only what differs from session to session is exploded:
the wording of a rule and the evidence it points at are looked up by its number afterwards, so a query
that does not read them does not build them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev

# ------------------------------------------------------------- fixed values: rule wording
RFC8996 = "RFC 8996 (BCP 195) SS4-5: TLS 1.0 and TLS 1.1 MUST NOT be used"
NIST_VERSIONS = ("NIST SP 800-52r2 SS3.1: servers shall use TLS 1.2, should use TLS 1.3, "
                 "should not use TLS 1.1, shall not use TLS 1.0/SSL 3.0/SSL 2.0")
RFC8446_FLOW = "RFC 8446 SS2 (handshake message flow)"
RFC5280_TRUST = ("RFC 5280 SS6 (path validation requires trust anchors, which a packet capture "
                 "does not contain)")
RFC6960_STATUS = "RFC 6960 (OCSP status is a separate network transaction)"
RFC8446_CERT = "RFC 8446 SS2 (Certificate is encrypted in TLS 1.3)"
RFC3207 = "RFC 3207 SS6 (SMTP STARTTLS security considerations)"
RFC2595 = "RFC 2595 (STARTTLS for IMAP and POP3)"
RFC8314_IMPLICIT = "RFC 8314 (implicit TLS for email submission and access)"
RFC8314_CLEAR = ("RFC 8314 SS3: cleartext email submission/access is obsolete; TLS is required "
                 "for credential protection")
NIST_PROTECT = "NIST SP 800-52r2 SS3.1 (TLS required to protect transmitted data)"
RFC8446_KEX = ("RFC 8446 SS4.2.8: TLS 1.3 negotiates key exchange in the key_share extension; "
               "the cipher suite does not encode it")
RFC8446_FS = ("RFC 8446 SS1.2 and App. D.5: TLS 1.3 removed static RSA and static "
              "Diffie-Hellman key exchange")
NIST_FS = ("NIST SP 800-52r2 SS3.3.1: servers shall be configured to use ephemeral key "
           "establishment")
RFC5280 = "RFC 5280: Internet X.509 PKI certificate and CRL profile"
RFC5280_PATH = ("RFC 5280 SS6: certification path validation requires a set of trust anchors, "
                "which a packet capture does not contain")
RFC5280_AKI = ("RFC 5280 SS4.2.1.1: the Authority Key Identifier identifies the key that signed "
               "a certificate, and is the intended means of chain building")
RFC6960 = ("RFC 6960: OCSP status is retrieved in a separate network transaction and is not "
           "present in a passively captured mail session")
RFC8446_ENCRYPTED = "RFC 8446 SS2: the TLS 1.3 Certificate message is encrypted"
NIST_KEYLEN = ("NIST SP 800-57 Part 1 Rev.5 SS5.6.1: RSA moduli below 2048 bits provide less "
               "than 112 bits of security and are disallowed")
RFC9155 = "RFC 9155: SHA-1 must not be used for digital signatures"
NIST_SHA1 = "NIST SP 800-131A Rev.2: SHA-1 signature generation is disallowed"
CFG_STANDARDS = ["RFC 8996 (BCP 195): TLS 1.0 and TLS 1.1 MUST NOT be used",
                 "NIST SP 800-52r2: TLS server configuration guidance",
                 "NIST SP 800-57 Part 1 Rev.5: key length guidance", RFC9155]
DEPRECATED_VERSIONS = ["SSL2.0", "SSL3.0", "TLS1.0", "TLS1.1"]
# --------------------------------------------------------------------- end of fixed values

ISSUE, OK, INFO, AMB, NOEV, NOOBS = ("OBSERVED_ISSUE", "COMPLIANT", "INFORMATIONAL", "AMBIGUOUS",
                                     "INSUFFICIENT_EVIDENCE", "NOT_OBSERVABLE")

Ladder = list[tuple]


@dataclass(frozen=True)
class Rule:
    """`ladder` gives (condition, status, severity, conclusion); the first match is reported."""

    rule_id: str
    title: str
    standards: list | Callable[[], Column]
    refs: list[str]
    applies: Callable[[], Column]
    ladder: Callable[[], Ladder]
    guidance: str = ""
    #: (condition, field): a further field consulted only when the condition holds
    extra_ref: Callable[[], tuple[Column, str]] | None = None


class RuleRegistry:
    """Ordered rules with unique ids."""

    def __init__(self, rules=()):
        self._rules: dict[str, Rule] = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> Rule:
        if not rule.rule_id:
            raise ValueError("a rule needs an id")
        if rule.rule_id in self._rules:
            raise ValueError(f"duplicate rule id: {rule.rule_id}")
        self._rules[rule.rule_id] = rule
        return rule

    @property
    def rules(self) -> list[Rule]:
        return list(self._rules.values())


# ----------------------------------------------------------------------------- predicates
def val(field: str) -> Column:
    return F.col(f"{field}.value")


def state(field: str) -> Column:
    return F.col(f"{field}.state")


def is_true(field: str) -> Column:
    return F.coalesce(val(field) == "true", F.lit(False))


def is_false(field: str) -> Column:
    return F.coalesce(val(field) == "false", F.lit(False))


def has_tls() -> Column:
    return F.col("tls_state") != "NONE"


def explicit() -> Column:
    return ~F.col("implicit_tls")


def n_certs() -> Column:
    return F.coalesce(F.size("certificates"), F.lit(0))


def dated(c: Column) -> Column:
    return c["not_before"].isNotNull() & c["not_after"].isNotNull()


def out_of_window(c: Column) -> Column:
    ref = F.col("start_epoch")
    return dated(c) & ((ref > c["not_after"]) | (ref < c["not_before"]))


def weak_key(c: Column) -> Column:
    return F.coalesce((c["key_algorithm"] == "RSA") & (c["key_bits"] < vocab.MIN_RSA_BITS),
                      F.lit(False))


def some(array: str, test) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def known_oid(oid: Column) -> Column:
    return oid.isin(list(vocab.SIGNATURE_OIDS))


def deprecated_oid(oid: Column) -> Column:
    return oid.isin([o for o, (_, _, h) in vocab.SIGNATURE_OIDS.items()
                     if h in vocab.DEPRECATED_HASHES])


def lone_self_signed() -> Column:
    return (n_certs() == 1) & F.coalesce(F.get("certificates", F.lit(0))["self_signed"],
                                         F.lit(False))


def by_protocol() -> Column:
    return F.when(F.col("protocol") == "smtp", F.array(F.lit(RFC3207))) \
        .otherwise(F.array(F.lit(RFC2595)))


OTHERWISE = object()


# ------------------------------------------------------------------------------ the rules
def _version_ladder() -> Ladder:
    v = val("tls_negotiated_version")
    return [
        (state("tls_negotiated_version") == "UNKNOWN", NOEV, "INFO",
         "The negotiated TLS version could not be established from this capture."),
        (state("tls_negotiated_version") == "AMBIGUOUS", AMB, "INFO",
         "A ServerHello was observed but its version value was not recognised."),
        (v.isin("SSL2.0", "SSL3.0"), ISSUE, "CRITICAL",
         F.concat(F.lit("The session negotiated "), v, F.lit(", a deprecated protocol version."))),
        (v.isin("TLS1.0", "TLS1.1"), ISSUE, "HIGH",
         F.concat(F.lit("The session negotiated "), v, F.lit(", a deprecated protocol version."))),
        (v.isin("TLS1.2", "TLS1.3"), OK, "INFO",
         F.concat(F.lit("The session negotiated "), v, F.lit(", which meets current guidance."))),
        (OTHERWISE, AMB, "INFO",
         F.concat(F.lit("Negotiated version '"), v, F.lit("' is outside the evaluated set."))),
    ]


def _handshake_ladder() -> Ladder:
    s = F.col("tls_state")
    agrees = (state("tls_transition") == "OBSERVED") & is_true("tls_transition")
    return [
        ((s == "ESTABLISHED") & ~agrees, AMB, "INFO",
         "TLS state and its supporting evidence disagree."),
        (s == "ESTABLISHED", OK, "INFO",
         "TLS negotiation completed and encrypted application data was observed."),
        (s.isin("CLIENT_HELLO_OBSERVED", "SERVER_HELLO_OBSERVED"), NOEV, "INFO",
         "TLS negotiation was observed but completion is not established."),
        (OTHERWISE, NOEV, "INFO",
         "TLS records were present but the handshake could not be reconstructed."),
    ]


def _upgrade_ladder() -> Ladder:
    return [
        (state("starttls_accepted") == "AMBIGUOUS", AMB, "INFO",
         "The server's response to the upgrade request was contradictory."),
        (is_false("starttls_accepted"), ISSUE, "MEDIUM",
         "The client requested an upgrade and the server refused it."),
        (is_true("starttls_accepted") & (F.col("tls_state") == "ESTABLISHED"), OK, "INFO",
         "The session successfully upgraded to TLS."),
        (is_true("starttls_accepted"), NOEV, "INFO",
         "The upgrade was accepted but completion was not established."),
        (OTHERWISE, NOEV, "INFO",
         "An upgrade was requested but no server response was captured."),
    ]


def _advertisement_ladder() -> Ladder:
    adv = "starttls_advertised"
    offered = (state(adv) == "OBSERVED") & is_true(adv)
    return [
        (offered & ~is_true("starttls_requested"), INFO, "INFO",
         "The server advertised an upgrade capability that the client did not use."),
        (state(adv) == "AMBIGUOUS", AMB, "INFO",
         "No upgrade capability was advertised; stripping and genuine non-support cannot be "
         "distinguished."),
        (state(adv) == "UNKNOWN", NOEV, "INFO",
         "No capability response was captured for this session."),
    ]


def _auth_ladder() -> Ladder:
    return [
        (F.col("tls_state") == "NONE", ISSUE, "HIGH",
         "Authentication commands were exchanged in cleartext; no TLS protection was observed "
         "for this session."),
        (OTHERWISE, INFO, "INFO",
         "Authentication activity was observed in the pre-TLS phase of the session."),
    ]


def _kex_ladder() -> Ladder:
    f = "tls_key_exchange"
    return [
        (state(f) == "UNKNOWN", NOEV, "INFO",
         "The key exchange mechanism could not be established."),
        (state(f) == "AMBIGUOUS", AMB, "INFO",
         "The key exchange mechanism could not be identified."),
        (OTHERWISE, INFO, "INFO", F.concat(F.lit("Key exchange: "), val(f), F.lit("."))),
    ]


def _fs_ladder() -> Ladder:
    f = "tls_forward_secrecy"
    return [
        (state(f) == "UNKNOWN", NOEV, "INFO",
         "Forward secrecy could not be assessed for this session."),
        (state(f) == "AMBIGUOUS", AMB, "INFO", "Forward secrecy could not be determined."),
        (is_true(f), OK, "INFO", "The session provides forward secrecy."),
        (OTHERWISE, ISSUE, "MEDIUM",
         "The negotiated key exchange does not provide forward secrecy."),
    ]


def _presence_ladder() -> Ladder:
    n = n_certs()
    return [
        (n == 0, NOOBS, "INFO", "No certificate was observable in this session."),
        (OTHERWISE, INFO, "INFO",
         F.concat(n.cast("string"), F.when(n == 1, " certificate").otherwise(" certificates"),
                  F.lit(" extracted from the cleartext handshake."))),
    ]


def _validity_ladder() -> Ladder:
    return [
        (F.col("start_epoch").isNull(), NOEV, "INFO",
         "Certificate validity could not be evaluated."),
        (F.col("_out_of_window"), ISSUE, "HIGH",
         "A certificate was outside its validity period during this session."),
        (~F.col("_dated"), NOEV, "INFO",
         "Certificate validity dates could not be read."),
        (OTHERWISE, OK, "INFO",
         "All observed certificates were within their validity period."),
    ]


def _key_ladder() -> Ladder:
    return [
        (F.col("_weak_key"), ISSUE, "HIGH",
         "A certificate uses an RSA key below the permitted length."),
        (~F.col("_sized"), NOEV, "INFO",
         "Certificate key strength could not be determined."),
        (OTHERWISE, OK, "INFO", "Observed certificate keys meet the minimum length."),
    ]


def _signature_ladder() -> Ladder:
    return [
        (F.col("_deprecated"), ISSUE, "HIGH",
         "A certificate in the chain is signed with a deprecated hash."),
        (~F.col("_known"), NOEV, "INFO",
         "Certificate signature algorithms could not be identified."),
        (OTHERWISE, OK, "INFO", "Certificate signature algorithms are current."),
    ]


def _structure_ladder() -> Ladder:
    return [
        (F.col("_lone_self_signed"), ISSUE, "MEDIUM",
         "The server presented a single self-signed certificate."),
        ((n_certs() > 1) & F.col("_broken"), AMB, "INFO",
         "The presented chain does not link end to end."),
        (OTHERWISE, INFO, "INFO", "Certificate chain structure analysed."),
    ]


def checklist() -> Column:
    """Status of each of the seven configuration items, in order."""
    v, fs = "tls_negotiated_version", "tls_forward_secrecy"
    none = n_certs() == 0
    leaf = F.get("certificates", F.lit(0))["self_signed"]
    conclusive = state(v).isin("OBSERVED", "INFERRED")
    items = [
        F.when(~conclusive, NOOBS).when(val(v).isin(DEPRECATED_VERSIONS), ISSUE).otherwise(OK),
        F.when(state(fs) == "UNKNOWN", NOOBS).when(state(fs) == "AMBIGUOUS", AMB)
         .when(is_true(fs), OK).otherwise(ISSUE),
        F.when(none | ~F.col("_sized"), NOOBS).when(F.col("_weak_key"), ISSUE).otherwise(OK),
        F.when(none, NOOBS).when(F.col("_deprecated"), ISSUE).when(~F.col("_known"), NOOBS).otherwise(OK),
        F.when(none | F.col("start_epoch").isNull() | ~F.col("_dated"), NOOBS)
         .when(F.col("_out_of_window"), ISSUE).otherwise(OK),
        F.when(none | leaf.isNull(), NOOBS).when(F.col("_lone_self_signed"), ISSUE).otherwise(OK),
        F.when(F.col("tls_state") == "NONE", ISSUE).otherwise(OK),
    ]
    return F.array(*items)


def tally(items: Column, status: str) -> Column:
    return F.size(F.filter(items, lambda s: s == status))


def _configuration_ladder() -> Ladder:
    items = F.col("_checklist")
    failed, passed = tally(items, ISSUE), tally(items, OK)
    return [
        (failed > 0, INFO, "INFO", F.concat(F.lit("Configuration checklist: "),
                                            failed.cast("string"), F.lit(" item(s) failed."))),
        (passed == 0, NOOBS, "INFO", "No configuration checklist item could be evaluated."),
        (OTHERWISE, OK, "INFO", F.concat(F.lit("Configuration checklist: "),
                                         passed.cast("string"), F.lit(" of 7 items passed."))),
    ]


DEFAULT_RULES = [
    Rule("SEC-TLS-001", "Negotiated TLS version posture", [RFC8996, NIST_VERSIONS],
         ["tls_negotiated_version"], has_tls, _version_ladder,
         "Turn the old versions off; accept TLS 1.2 and, better, TLS 1.3."),
    Rule("SEC-TLS-002", "TLS handshake completion evidence", [RFC8446_FLOW],
         ["tls_transition"], has_tls, _handshake_ladder),
    Rule("SEC-TLS-003", "Certificate trust and revocation boundary",
         [RFC5280_TRUST, RFC6960_STATUS, RFC8446_CERT],
         ["tls_negotiated_version", "tls_certificate_chain"], has_tls,
         lambda: [(OTHERWISE, NOOBS, "INFO",
                   "Certificate trust and revocation were not evaluated.")]),
    Rule("SEC-STLS-002", "STARTTLS/STLS advertisement posture", by_protocol,
         ["starttls_advertised"], explicit, _advertisement_ladder,
         extra_ref=lambda: ((state("starttls_advertised") == "OBSERVED")
                            & is_true("starttls_advertised"), "starttls_requested")),
    Rule("SEC-STLS-001", "STARTTLS/STLS upgrade outcome", by_protocol,
         ["starttls_requested", "starttls_accepted"],
         lambda: explicit() & is_true("starttls_requested"), _upgrade_ladder,
         "Offer and accept the upgrade, and let clients insist on it.",
         lambda: (is_true("starttls_accepted") & (state("starttls_accepted") != "AMBIGUOUS"),
                  "tls_transition")),
    Rule("SEC-STLS-003", "Implicit TLS session", [RFC8314_IMPLICIT],
         ["starttls_advertised", "tls_transition"], lambda: F.col("implicit_tls"),
         lambda: [(OTHERWISE, INFO, "INFO",
                   "The session used implicit TLS; no STARTTLS upgrade applies.")]),
    Rule("SEC-PLAIN-001", "Authentication activity without TLS protection",
         [RFC8314_CLEAR, NIST_PROTECT], ["auth_activity", "tls_transition"],
         lambda: explicit() & (state("auth_activity") != "NOT_OBSERVABLE")
         & is_true("auth_activity"), _auth_ladder,
         "Accept credentials only once TLS is up."),
    Rule("SEC-PLAIN-002", "Mail session carried no TLS", [RFC8314_CLEAR, NIST_PROTECT],
         ["tls_transition", "starttls_advertised"],
         lambda: explicit() & F.col("protocol").isNotNull() & ~has_tls()
         & (state("tls_transition") == "OBSERVED") & is_false("tls_transition"),
         lambda: [(OTHERWISE, ISSUE, "MEDIUM",
                   "The mail session carried no TLS protection.")],
         "Require TLS, by implicit TLS ports or an enforced upgrade."),
    Rule("SEC-KEX-001", "Key exchange mechanism", [RFC8446_KEX],
         ["tls_key_exchange", "tls_named_group", "tls_cipher_suite_name"], has_tls, _kex_ladder),
    Rule("SEC-FS-001", "Forward secrecy", [RFC8446_FS, NIST_FS],
         ["tls_forward_secrecy", "tls_key_exchange", "tls_negotiated_version"], has_tls,
         _fs_ladder, "Prefer ephemeral key exchange and drop static RSA and static DH."),
    Rule("SEC-CERT-001", "Certificate extraction", [RFC5280, RFC8446_ENCRYPTED],
         ["tls_certificate_chain", "tls_negotiated_version"], has_tls, _presence_ladder),
    Rule("SEC-CERT-002", "Certificate validity period", [RFC5280], ["tls_certificate_chain"],
         lambda: n_certs() > 0, _validity_ladder, "Renew the certificate and automate renewal."),
    Rule("SEC-CERT-003", "Certificate public key strength", [NIST_KEYLEN],
         ["tls_certificate_chain"], lambda: n_certs() > 0, _key_ladder,
         "Reissue with RSA of 2048 bits or more, or with ECDSA."),
    Rule("SEC-CERT-004", "Certificate signature algorithm", [RFC9155, NIST_SHA1],
         ["tls_certificate_chain"], lambda: n_certs() > 0, _signature_ladder,
         "Reissue with SHA-256 or stronger signatures."),
    Rule("SEC-CERT-005", "Certificate chain structure", [RFC5280_AKI, RFC5280_PATH, RFC6960],
         ["tls_certificate_chain"], lambda: n_certs() > 0, _structure_ladder,
         "Use an issuer the clients already trust, or distribute the private root."),
    Rule("SEC-CFG-001", "Insecure protocol configuration", CFG_STANDARDS,
         ["tls_negotiated_version", "tls_forward_secrecy", "tls_certificate_chain"],
         lambda: F.lit(True), _configuration_ladder),
]
BASE_RULES = DEFAULT_RULES[:8]
CERTIFICATE_RULES = [r for r in DEFAULT_RULES if r.rule_id.startswith("SEC-CERT")
                     and r.rule_id != "SEC-CERT-001"]


def rule(rule_id: str) -> Rule:
    return next(r for r in DEFAULT_RULES if r.rule_id == rule_id)


def ref(field: str) -> Column:
    """Pointer from a finding to the evidence field it consulted."""
    c = F.col(field)
    return F.struct(F.lit(field).alias("field"), c["value"].alias("observed_value"),
                    c["state"].alias("evidence_state"), c["frame_lo"].alias("frame_lo"),
                    c["frame_hi"].alias("frame_hi"), c["frame_n"].alias("frame_n"),
                    c["provenance"].alias("provenance"))


def certificate_facts() -> dict[str, Column]:
    """What the ladders ask of the chain of a session; each is worked out once per session."""
    return {
        "_out_of_window": some("certificates", out_of_window), "_dated": some("certificates", dated),
        "_weak_key": some("certificates", weak_key),
        "_sized": some("certificates", lambda c: c["key_bits"].isNotNull()),
        "_deprecated": some("chain_signature_oids", deprecated_oid),
        "_known": some("chain_signature_oids", known_oid),
        "_broken": some("chain_links", lambda x: ~x), "_lone_self_signed": lone_self_signed()}


def with_facts(sessions: DataFrame) -> DataFrame:
    """Sessions with the facts the ladders read, as far as their columns allow."""
    if "certificates" not in sessions.columns:
        return sessions
    sessions = sessions.withColumns(certificate_facts())
    if "tls_forward_secrecy" not in sessions.columns:
        return sessions
    return sessions.withColumn("_checklist", checklist())


def pick(ladder: Ladder, applies: Column, names: tuple[str, ...]) -> Column:
    """The first rung of a ladder whose condition holds, as a struct; null where the rule is silent."""
    picked = None
    for condition, *values in ladder:
        body = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values)])
        if condition is OTHERWISE:
            condition = F.lit(True)
        picked = F.when(condition, body) if picked is None else picked.when(condition, body)
    return F.when(applies, picked)


def by_number(values: list, number: Column) -> Column:
    """The entry of a list of texts, or of lists, with this number."""
    def literal(v):
        return F.array(*[literal(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.get(literal(values), number)


def refs_of(pool: str, fields: list[str], wanted: list[list[str]], number: Column) -> Column:
    """The evidence pointers a rule consulted, taken from the pointers of its session."""
    places = [[fields.index(f) for f in one] for one in wanted]
    return F.transform(by_number(places, number), lambda i: F.get(F.col(pool), i))


def outcome(r: Rule, seq: int) -> Column:
    """One candidate finding; `o` stays null where the rule does not speak."""
    more = F.coalesce(r.extra_ref()[0], F.lit(False)) if r.extra_ref is not None else F.lit(False)
    return F.struct(F.lit(seq).alias("seq"), more.alias("_more"),
                    pick(r.ladder(), r.applies(), ("status", "severity", "conclusion")).alias("o"))


def run_rules(sessions: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of every rule over every session, in one scan.  Outcomes are exploded as an outer join: an inner
    explode would have Spark work out every ladder once more below it, to see whether the list is empty."""
    rules = DEFAULT_RULES if rules is None else rules
    consulted = [[r.refs, [*r.refs, r.extra_ref()[1]] if r.extra_ref is not None else r.refs] for r in rules]
    fields = list(dict.fromkeys(f for pair in consulted for one in pair for f in one))
    seq, ids = F.col("seq"), ["capture_id", "tcp_stream_id", "stream_key", "protocol", "first_frame",
                              "last_frame", "start_epoch"]
    own = {f"_standards{i}": r.standards() for i, r in enumerate(rules) if callable(r.standards)}
    standards = by_number([[] if callable(r.standards) else list(r.standards) for r in rules], seq).cast("array<string>")
    for i, r in enumerate(rules):
        if callable(r.standards):
            standards = F.when(seq == i, F.col(f"_standards{i}")).otherwise(standards)
    judged = with_facts(sessions).select(
        *ids, *[c.alias(n) for n, c in own.items()], ev.packed_states(fields).alias("_states"), F.array(*[ref(f) for f in fields]).alias("_refs"),
        F.array(*[outcome(r, i) for i, r in enumerate(rules)]).alias("_outcomes"))
    wanted, number = [one for pair in consulted for one in pair], seq * 2 + F.col("_more").cast("int")
    refs = refs_of("_refs", fields, wanted, number)
    return (judged.select(*ids, *own, "_refs", "_states", F.inline_outer("_outcomes")).filter(F.col("o").isNotNull())
            .select(casts.finding_id(by_number([r.rule_id for r in rules], seq),
                                     F.col("capture_id"), F.col("tcp_stream_id"), F.col("o.status"))
                    .alias("finding_id"),
                    by_number([r.rule_id for r in rules], seq).alias("rule_id"),
                    by_number([r.title for r in rules], seq).alias("title"),
                    "o.status", "o.severity", "o.conclusion", standards.alias("standards"),
                    refs.alias("evidence_refs"), by_number([r.guidance for r in rules], seq).alias("guidance"),
                    "seq", "capture_id", "tcp_stream_id",
                    "stream_key", "protocol", "first_frame", "last_frame",
                    F.col("start_epoch").alias("timestamp_epoch"),
                    ev.bits_of_packed(F.col("_states"), fields, wanted, number).alias("evidence_states")))


def invariant_violations(findings: DataFrame) -> DataFrame:
    """Findings that assert impact without an issue, cite nothing, or point at no evidence."""
    problem = (F.when((F.col("status") != ISSUE) & (F.col("severity") != "INFO"),
                      "severity without an observed issue")
               .when((F.col("status") == ISSUE) & (F.size("standards") == 0),
                     "issue without a standard")
               .when(F.size("evidence_refs") == 0, "finding without evidence"))
    return findings.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by status and by severity, per capture."""
    axis = F.explode(F.array(
        F.struct(F.lit("status").alias("axis"), F.col("status").alias("bucket")),
        F.struct(F.lit("severity").alias("axis"), F.col("severity").alias("bucket"))))
    return findings.select("capture_id", axis.alias("a")).groupBy("capture_id", "a.axis", "a.bucket") \
        .agg(F.count(F.lit(1)).alias("findings"))
