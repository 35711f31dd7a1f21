"""Joining the findings of all lanes into facts, and facts into issue groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev
from wirepost.plans import lineage

FUSE_KEY = ["capture_id", "issue_class", "fact_kind", "stream_key"]
ABSTAINING = list(vocab.ABSTAIN_REASON)
RANKABLE = ["BASE_SECURITY_ISSUE", "BEHAVIOURAL_DEVIATION", "ANOMALY_SIGNAL"]
#: in the order of their names, so that the least number is the least name
STATUS_ORDER, DIMENSIONS = sorted(vocab.STATUSES), sorted(set(vocab.CLASS_DIMENSION.values()))
CONCLUDING = ["BASE_SECURITY_ISSUE", "BEHAVIOURAL_DEVIATION", "POSITIVE_EVIDENCE"]

#: input that would let the operator named by the reason decide
RESOLUTION = {
    "AMBIGUOUS_EVIDENCE": "the mail log or TLS settings of the server: RFC 3207 lets a server offer STARTTLS to some clients only",
    "INSUFFICIENT_CAPTURE": "packets from the TCP SYN to the FIN or RST of this stream, taken without a snap length",
    "NOT_OBSERVABLE": "keys or logs of an endpoint: TLS 1.3 encrypts what follows the ServerHello (RFC 8446, section 4.3.1)",
    "INSUFFICIENT_HISTORY": "a baseline: earlier captures in which this client reaches the same address and port",
    "CONTRADICTORY_EVIDENCE": "a second tap on the path; compare its TCP sequence numbers with those seen here",
    "NOT_COMPARABLE": "captures that hold both sides of the comparison: equal client, server address, port, protocol and TLS mode",
    "UNSUPPORTED_PROTOCOL_VARIANT": "a custom rule, passed to the rule runner, that reads this command set",
}

#: issue class -> (observed, why it matters, action, verification), after RFC 2595, 3207, 4954, 8314,
#: 8446, 8996 and 9325 and NIST SP 800-52 Rev. 2
REMEDIATION = {
    "DEPRECATED_TLS_VERSION": (
        "The ServerHello selected SSL 3.0, TLS 1.0 or TLS 1.1.",
        "RFC 8996 says these MUST NOT be negotiated: their handshakes rely on MD5 and SHA-1. "
        "NIST SP 800-52 Rev. 2 asks servers for TLS 1.2 and, since 2024, TLS 1.3.",
        "Postfix: smtpd_tls_protocols = >=TLSv1.2; Dovecot: ssl_min_protocol = TLSv1.2; "
        "Exim: openssl_options = +no_tlsv1 +no_tlsv1_1. Reload every listener, submission included.",
        "openssl s_client -tls1_1 has to end in a protocol_version alert on each port, -tls1_2 in a handshake."),
    "PLAINTEXT_AUTH_EXPOSURE": (
        "AUTH, LOGIN or USER/PASS left the client before any TLS record.",
        "PLAIN and LOGIN are Base64, not encryption. RFC 4954 and RFC 2595 allow them only below a "
        "protecting layer, RFC 8314 deprecates cleartext access altogether.",
        "Postfix: smtpd_tls_auth_only = yes; Dovecot: disable_plaintext_auth = yes. Move clients to ports 465, "
        "993 and 995, and replace the passwords that were sent.",
        "EHLO without TLS must list no AUTH; IMAP must list LOGINDISABLED; POP3 must answer USER with -ERR."),
    "NO_TLS_PROTECTION": (
        "The stream holds mail commands and no TLS handshake up to its last packet.",
        "RFC 8314 calls for TLS on all submission and access traffic; RFC 7435 explains why relays should at "
        "least encrypt opportunistically.",
        "Submission and access: close 110 and 143 or demand STARTTLS there. Relay: smtpd_tls_security_level = may "
        "and a certificate on port 25, with MTA-STS (RFC 8461) or DANE (RFC 7672) published.",
        "MAIL FROM on port 587 before STARTTLS must give 530; the relay must list STARTTLS after EHLO."),
    "STARTTLS_UPGRADE_FAILURE": (
        "STARTTLS or STLS was sent, and no completed handshake follows on that stream.",
        "RFC 3207, section 4.1, leaves it to the client to go on after a failure, so opportunistic clients may "
        "continue in the clear; section 6 names the attacker who provokes that.",
        "Read the TLS error in the server log (key, chain and cipher list are the usual causes) and set clients "
        "to encrypt or verify, such as smtp_tls_security_level = encrypt.",
        "openssl s_client -starttls smtp (imap, pop3) must print a session and the expected chain."),
    "STARTTLS_BEHAVIOUR_DEVIATION": (
        "This stream and its baseline disagree on offering, requesting or completing STARTTLS.",
        "RFC 3207, section 6, describes deletion of the 250 STARTTLS line; a changed server configuration or an "
        "SMTP inspecting firewall gives the same packets.",
        "Fetch the capability reply from inside the server network and from the client network. If only the "
        "latter lacks STARTTLS, look for inspection on the path; publish MTA-STS or DANE.",
        "Both networks must receive equal capability replies in three captures on different days."),
    "TLS_VERSION_DEVIATION": (
        "The ServerHello version of this stream is another one than that of its baseline.",
        "RFC 8446, section 4.1.3, marks a forced downgrade in the last eight bytes of ServerHello.random; "
        "RFC 9325 asks clients not to fall back to lower versions.",
        "Look at library updates and policy changes on both ends since the baseline, then at TLS proxies between "
        "them; remove fallback retries from the client.",
        "The random of new ServerHellos must not end in DOWNGRD and 00 or 01; the version must equal the baseline."),
}


#: what scores, counts and groups read of a classified finding
SLIM = [*FUSE_KEY, "lane", "rule_id", "status", "severity", "dimension", "protocol", "evidence_states"]


# ------------------------------------------------------------------------------- lanes in
def with_bits(findings: DataFrame) -> DataFrame:
    """Findings with the bits of the states they consulted; rules of this package bring them along."""
    if "evidence_states" in findings.columns:
        return findings
    return findings.withColumn("evidence_states", ev.bits_of(F.col("evidence_refs")))


def union_findings(findings: DataFrame, cross: DataFrame | None = None) -> DataFrame:
    """Both lanes in one frame; `seq` keeps rule order, per-session rules first."""
    det = with_bits(findings).withColumns({"lane": F.lit("DETERMINISTIC"),
                                "deviation": F.lit(None).cast("string")})
    if cross is not None:
        crossed = with_bits(cross).withColumns({"lane": F.lit("CROSS_SESSION"), "guidance": F.lit("")})
        det = det.unionByName(crossed, allowMissingColumns=True)
    return det.select("lane", "finding_id", "rule_id", "title", "status", "severity", "deviation",
                      "conclusion", "standards", "evidence_refs", "guidance", "seq", "capture_id",
                      "tcp_stream_id", "stream_key", "protocol", "evidence_states")


def own_id() -> Column:
    """The id of a finding of the rules and the comparison rules, worked out of the columns it stands for."""
    parts = [F.col(c) for c in ("rule_id", "capture_id", "tcp_stream_id", "status")]
    return F.when(F.col("lane") == "CROSS_SESSION", casts.finding_id(*parts, F.col("deviation"))).otherwise(casts.finding_id(*parts))


def fact_kind(status: Column, lane: Column) -> Column:
    return (F.when(status.isin("COMPLIANT", "INFORMATIONAL"), "POSITIVE_EVIDENCE")
            .when(status.isin(ABSTAINING), "ABSTENTION")
            .when(lane == "CROSS_SESSION", "BEHAVIOURAL_DEVIATION")
            .otherwise("BASE_SECURITY_ISSUE"))


def classify_findings(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """Issue class, risk dimension and fact kind of every finding."""
    joined = findings.join(F.broadcast(vocab.dim_class(spark)), "rule_id", "left")
    return joined.withColumns({
        "issue_class": F.coalesce("issue_class", F.lit("UNCLASSIFIED")),
        "dimension": F.coalesce("dimension", F.lit("CRYPTO_CONFIGURATION")),
        "fact_kind": fact_kind(F.col("status"), F.col("lane"))})


def abstentions(classified: DataFrame, has_baseline: str | None = None) -> DataFrame:
    """Refusals to conclude, with the reason and what would settle them.

    `has_baseline` names a boolean column; a cross-session abstention without a baseline is a
    lack of history.  Without the column every cross finding is taken to carry its baseline.
    Findings without their wording or evidence give abstentions without what is taken from it.
    """
    reason = None
    for status, name in vocab.ABSTAIN_REASON.items():
        reason = F.when(F.col("status") == status, name) if reason is None \
            else reason.when(F.col("status") == status, name)
    if has_baseline:
        reason = F.when((F.col("lane") == "CROSS_SESSION") & (F.col("deviation") == "NOT_ASSESSED")
                        & ~F.col(has_baseline), "INSUFFICIENT_HISTORY").otherwise(reason)
    out = classified.filter(F.col("fact_kind") == "ABSTENTION").withColumn("reason", reason)
    resolved = F.lit(None).cast("string")
    for name, text in RESOLUTION.items():
        resolved = F.when(F.col("reason") == name, text).otherwise(resolved)
    frames = F.aggregate("evidence_refs", F.lit(0).cast("bigint"),
                         lambda acc, r: acc + F.coalesce(r["frame_n"], F.lit(0)))
    have = set(classified.columns)
    title = [F.col("title").alias("what_could_not_be_concluded")] if "title" in have else []
    why = [F.col("conclusion").alias("why")] if "conclusion" in have else []
    return out.select("capture_id", "reason", "issue_class", *title, *why, resolved.alias("resolved_by"), "rule_id",
                      "stream_key", "protocol", *([frames.alias("frame_count")] if "evidence_refs" in have else []))


# --------------------------------------------------------------------------------- fusion
def citation(text: Column) -> Column:
    """A standards string with the registered standard it names; the first marker found wins."""
    def named(standard, section):
        return F.struct(F.lit(standard).alias("standard"), F.lit(section).alias("section"), text.alias("text"))
    found = None
    for marker, name, part in vocab.STANDARD_MARKERS:
        found = F.when(text.contains(marker), named(name, part)) if found is None else found.when(text.contains(marker), named(name, part))
    return found.otherwise(named(vocab.UNMAPPED, ""))


def resolve_citations(texts: Column) -> Column:
    """Distinct citations of an array of standards strings, in display order."""
    kept = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    return F.sort_array(F.array_distinct(F.transform(kept, citation)))


#: every standard that `citation` can name
STANDARDS = list(dict.fromkeys([*(name for _, name, _ in vocab.STANDARD_MARKERS), vocab.UNMAPPED]))


def cited_standards(classified: DataFrame) -> DataFrame:
    """Every finding with each standard it cites, once.  Standards are of a closed vocabulary and travel as
    bits, the id of a finding as a number; an id that is no number travels as it is."""
    bit = F.create_map(*[F.lit(x) for i, name in enumerate(STANDARDS) for x in (name, 1 << i)])
    bits = F.aggregate(resolve_citations(F.col("standards")), F.lit(0).cast("bigint"),
                       lambda seen, c: seen.bitwiseOR(F.element_at(bit, c["standard"]).cast("bigint")))
    number = casts.id_number(F.col("finding_id"))
    rows = classified.select(number.alias("_number"), F.when(number.isNull(), F.col("finding_id")).alias("_text"), bits.alias("_bits"))
    names = F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, name) for i, name in enumerate(STANDARDS)])
    return rows.groupBy("_number", "_text").agg(F.bit_or("_bits").alias("_bits")).select(
        F.coalesce(casts.id_text(F.col("_number")), F.col("_text")).alias("finding_id"), F.explode(F.array_compact(names)).alias("standard"))


def _consulted(*states: str) -> Column:
    return F.exists("evidence_refs", lambda r: r["evidence_state"].isin(list(states)))


def certainty_of(uncertain: Column, inferred: Column, observed: Column, any_ref: Column) -> Column:
    """The weakest consulted observation decides."""
    return (F.when(~any_ref, "UNDETERMINED").when(uncertain, "UNCERTAIN")
            .when(inferred, "PROBABLE").when(observed, "CONFIRMED").otherwise("UNDETERMINED"))


def certainty(findings: DataFrame) -> DataFrame:
    """Certainty and observability of single findings, from the states they consulted."""
    seen = F.size("evidence_refs") > 0
    return findings.withColumns({
        "certainty": certainty_of(_consulted("AMBIGUOUS", "INCOMPLETE"), _consulted("INFERRED"),
                                  _consulted("OBSERVED"), seen),
        "observability": F.when(F.col("status") == "NOT_OBSERVABLE", "NOT_OBSERVABLE")
        .when(_consulted("NOT_OBSERVABLE"), "PARTIALLY_OBSERVABLE").otherwise("OBSERVABLE")})


def source_relations(classified: DataFrame) -> DataFrame:
    """How each source relates to its fact; a rule that reports twice is a duplicate.  The findings of a
    session travel together: side by side they are packed into a third of the bytes."""
    w = W.partitionBy(*FUSE_KEY, "rule_id").orderBy("lane", "finding_id")
    own = F.when(F.col("lane") == "DETERMINISTIC", "supports") \
        .when(F.col("fact_kind") == "BEHAVIOURAL_DEVIATION", "enriches") \
        .otherwise("contextualizes")
    return classified.filter(F.col("fact_kind") != "ABSTENTION").repartition("capture_id", "stream_key").withColumn(
        "relation", F.when(F.row_number().over(w) > 1, "duplicates").otherwise(own))


def _relation(source: Column, kind: Column) -> Column:
    return F.when(source["lane"] == "DETERMINISTIC", "supports") \
        .when(kind == "BEHAVIOURAL_DEVIATION", "enriches").otherwise("contextualizes")


def fuse_hash() -> Column:
    """Equal for findings of one fact; the few others it is equal for do no harm where it only parts rows."""
    return F.xxhash64(*FUSE_KEY)


CLASSES = list(dict.fromkeys(vocab.RULE_CLASS.values()))


def _cell() -> Column:
    """A bit for each class and kind of the vocabulary; what is outside it shares one."""
    bits = {f"{c}|{k}": 1 << i for i, (c, k) in enumerate((c, k) for c in CLASSES for k in CONCLUDING)}
    table = F.create_map(*[F.lit(x) for name, bit in bits.items() for x in (name, bit)])
    return F.coalesce(F.element_at(table, F.concat_ws("|", "issue_class", "fact_kind")), F.lit(1 << 62))


def shared_hashes(classified: DataFrame) -> DataFrame:
    """The `fuse_hash` of every fact that has more than one source.

    First a session's findings are counted beside the set of their classes and kinds, which is a row of
    numbers per session.  Only sessions with more findings than classes and kinds can have such a fact;
    if they are few, the findings of no others are looked at.
    """
    facts = classified.filter(F.col("fact_kind") != "ABSTENTION").withColumn("_session", F.xxhash64("capture_id", "stream_key"))
    several = lineage.written(facts.groupBy("_session").agg(F.count(F.lit(1)).alias("_n"), F.bit_or(_cell()).alias("_cells"))
                              .filter(F.col("_n") > F.bit_count("_cells")).select("_session"))
    if lineage.is_few(several):
        facts = facts.join(F.broadcast(several), "_session", "left_semi")
    return facts.groupBy(fuse_hash().alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")


def fuse_table(classified: DataFrame) -> DataFrame:
    """`fuse` of findings that are a table already, which is read once more for its facts of several sources."""
    shared = lineage.written(shared_hashes(classified))
    return fuse(classified, shared if lineage.is_few(shared) else None)


def fuse(classified: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One fact per (capture, class, kind, stream).

    The rule set bounds the sources of a fact, so a fact is a small row.  Sources that disagree
    on the outcome leave the less certain reading, except that an observed issue stands.  Status,
    severity, dimension and consulted states are of closed vocabularies and travel as numbers, which
    Spark adds up in a hash table; a text among the aggregates makes it sort all findings.  Findings
    without their wording or evidence give facts without what rests on it.

    The rules of this package report once on a class and kind of a stream, so a fact with several sources is
    rare.  `shared` lists the hashes of those (`shared_hashes`), few enough to be sent to every task: the
    other findings become facts where they are, and only these are grouped.
    """
    classified = with_bits(classified)
    facts = classified.filter(F.col("fact_kind") != "ABSTENTION")
    if shared is None:
        return resolve(_sourced(facts))
    hashed, few = facts.withColumn("_hash", fuse_hash()), F.broadcast(shared)
    alone = _sourced(hashed.join(few, "_hash", "left_anti").drop("_hash"), alone=True)
    return resolve(alone.unionByName(_sourced(hashed.join(few, "_hash", "left_semi").drop("_hash"))))


def _sourced(facts: DataFrame, alone: bool = False) -> DataFrame:
    """Findings grouped to facts.  With `alone` every finding is the only source of its fact and is not
    grouped; the columns are the same."""
    first = F.struct(F.when(F.col("lane") == "DETERMINISTIC", 0).otherwise(1), F.col("seq"),
                     F.col("finding_id"))
    issue_rank = F.when(F.col("status") == "OBSERVED_ISSUE",
                        ev.rank(F.col("severity"), vocab.SEVERITIES))
    status, dimension = ev.rank(F.col("status"), STATUS_ORDER), ev.rank(F.col("dimension"), DIMENSIONS)
    source = F.struct("lane", "rule_id", "finding_id", "status", "severity", "deviation",
                      "standards", "evidence_refs", F.col("conclusion").alias("detail"))
    ordered = ["lane", "seq", "finding_id"]

    def by_first(c):
        return F.col(c) if alone else F.min_by(c, first)

    def of(aggregate, c):
        return c if alone else aggregate(c)
    worded = {
        "title": (["title", *ordered], by_first("title")),
        "conclusion": (["conclusion", *ordered], by_first("conclusion")),
        "rule_guidance": (["guidance", *ordered], by_first("guidance")),
        "protocol": (["protocol"], of(F.min, F.col("protocol"))),
        "tcp_stream_id": (["tcp_stream_id"], of(F.min, F.col("tcp_stream_id"))),
        "_standards": (["standards"], F.coalesce("standards", F.array().cast("array<string>")) if alone else F.flatten(F.collect_set("standards"))),
        "_sources": ([*ordered, "rule_id", "deviation", "standards", "evidence_refs", "conclusion"],
                     F.array(source) if alone else F.array_sort(F.collect_list(source)))}
    columns = {
        "_dimension": of(F.min, dimension), "_issue_rank": of(F.max, issue_rank),
        "_s0": of(F.min, status), "_s1": of(F.max, status),
        "source_count": F.lit(1).cast("bigint") if alone else F.count(F.lit(1)), "_bits": of(F.bit_or, F.col("evidence_states")),
        **{name: c for name, (needs, c) in worded.items() if set(needs) <= set(facts.columns)}}
    named = [c.alias(name) for name, c in columns.items()]
    return facts.select(*FUSE_KEY, *named) if alone else facts.groupBy(*FUSE_KEY).agg(*named)


def resolve(grouped: DataFrame) -> DataFrame:
    """Settle contradictions, then severity, certainty and observability."""
    contradiction = F.col("_s0") != F.col("_s1")
    issue = F.col("_issue_rank").isNotNull()
    status = F.when(~contradiction, ev.unrank(F.col("_s0"), STATUS_ORDER)).when(issue, "OBSERVED_ISSUE") \
        .otherwise("AMBIGUOUS")
    severity = F.when(issue, ev.unrank(F.col("_issue_rank"), vocab.SEVERITIES)).otherwise("INFO")

    def seen(bit):
        return F.col("_bits").bitwiseAND(F.lit(bit)) != 0
    consulted = ev.CONSULTED
    sure = certainty_of(seen(consulted["AMBIGUOUS"]), seen(consulted["INFERRED"]), seen(consulted["OBSERVED"]), seen(ev.ANY))

    def marked(s, i):
        again = F.exists(F.slice("_sources", F.lit(1), i), lambda p: p["rule_id"] == s["rule_id"])
        return s.withField("relation", F.when(again, "duplicates")
                           .otherwise(_relation(s, F.col("fact_kind"))))
    settled = {
        "dimension": ev.unrank(F.col("_dimension"), DIMENSIONS),
        "contradiction": contradiction, "status": status, "severity": severity,
        "certainty": F.when(contradiction & (sure == "CONFIRMED"), "UNCERTAIN").otherwise(sure),
        "observability": F.when(seen(consulted["NOT_OBSERVABLE"]), "PARTIALLY_OBSERVABLE").otherwise("OBSERVABLE"),
        "duplicates": F.col("source_count") - 1}
    if "_standards" in grouped.columns:
        settled["citations"] = resolve_citations(F.array_distinct("_standards"))
    if "_sources" in grouped.columns:
        only = F.get("_sources", F.lit(0))
        settled["sources"] = F.when(F.size("_sources") == 1, F.array(only.withField("relation", _relation(only, F.col("fact_kind"))))) \
            .otherwise(F.transform("_sources", marked))
    return grouped.withColumns(settled).withColumn("penalising", (F.col("status") == "OBSERVED_ISSUE")
                                                   & F.col("fact_kind").isin(RANKABLE[:2])) \
        .drop("_dimension", "_issue_rank", "_s0", "_s1", "_bits", "_standards", "_sources")


def anomaly_facts(results: DataFrame) -> DataFrame:
    """Anomalous sessions as facts of their own kind; they never penalise."""
    return results.filter(F.col("band") == "ANOMALOUS").select(
        "capture_id", F.lit("ANOMALY").alias("issue_class"),
        F.lit("ANOMALY_SIGNAL").alias("fact_kind"), "stream_key",
        F.lit("Session is statistically unlike the learned normal").alias("title"),
        F.lit("The feature vector is an outlier of its population; that is neither a weakness "
              "nor an attack.").alias("conclusion"),
        F.lit("BEHAVIOURAL_CONSISTENCY").alias("dimension"),
        F.lit(None).cast("string").alias("protocol"), F.lit(1).cast("bigint").alias("source_count"),
        F.lit(False).alias("contradiction"), F.lit("INFORMATIONAL").alias("status"),
        F.lit("INFO").alias("severity"), F.lit("UNDETERMINED").alias("certainty"),
        F.lit("OBSERVABLE").alias("observability"), F.lit(0).cast("bigint").alias("duplicates"),
        F.lit(False).alias("penalising"), F.col("band").alias("ml_band"))


def attach_anomalies(fused: DataFrame, results: DataFrame) -> DataFrame:
    """Add the anomaly facts, and to every other fact the signal of its session."""
    scored = results.filter(F.col("band") != "NOT_SCORED") \
        .select("capture_id", "stream_key", F.col("band").alias("ml_band"))
    return fused.join(scored, ["capture_id", "stream_key"], "left") \
        .unionByName(anomaly_facts(results), allowMissingColumns=True)


def order_fused(fused: DataFrame) -> DataFrame:
    """Worst first, then by class, kind and stream."""
    return fused.orderBy(ev.rank(F.col("severity"), vocab.SEVERITIES).desc(), "issue_class",
                         "fact_kind", F.coalesce("stream_key", F.lit("None")))


def remediation(spark: SparkSession, fused: DataFrame) -> DataFrame:
    """Guidance for observed issues whose class has a template."""
    rows = [(cls, *texts) for cls, texts in REMEDIATION.items()]
    dim = F.broadcast(vocab.inline(
        spark, rows, "issue_class string, observed string, why_it_matters string, action string, "
        "verification string"))
    own = F.trim(F.coalesce("rule_guidance", F.lit("")))
    scope = F.concat(F.lit("session "), F.coalesce("stream_key", F.lit("None")),
                     F.coalesce(F.concat(F.lit(" ("), F.col("protocol"), F.lit(")")), F.lit("")))
    return (fused.filter(F.col("status") == "OBSERVED_ISSUE").join(dim, "issue_class")
            .withColumns({"recommended_action": F.when(own == "", F.col("action")).otherwise(
                F.concat(F.col("action"), F.lit(" Rule guidance: "), own)),
                "affected_scope": scope}).drop("action"))


# --------------------------------------------------------------------------------- groups
def issue_groups(fused: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Facts of one class and kind across a capture.  A fact names its stream once, so counting
    streams needs no distinct."""
    ml = "ml_band" in fused.columns
    sev = ev.rank(F.col("severity"), vocab.SEVERITIES)
    sure = ev.rank(F.col("certainty"), vocab.CERTAINTIES)
    stream = F.coalesce("stream_key", F.lit("None"))
    cites = F.col("citations") if "citations" in fused.columns \
        else F.array().cast("array<struct<standard:string,section:string,text:string>>")
    nudge = F.when(F.col("ml_band") == "ANOMALOUS", 4.0) \
        .when(F.col("ml_band") == "BORDERLINE", 2.0).otherwise(0.0) if ml else F.lit(0.0)
    grouped = fused.groupBy("capture_id", *extra_keys, "issue_class", "fact_kind").agg(
        F.max(sev).alias("severity_rank"), F.min(sure).alias("_sure"),
        F.count("stream_key").alias("recurrence"), F.count(F.lit(1)).alias("finding_count"),
        F.bool_or("penalising").alias("penalising"), F.min("dimension").alias("dimension"),
        *([F.min_by("title", F.struct(-sev, stream)).alias("title")] if "title" in fused.columns else []),
        F.min_by("stream_key", F.struct(-sev, -sure, stream)).alias("representative"),
        *([F.array_sort(F.collect_set("protocol")).alias("protocols")] if "protocol" in fused.columns else []),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(cites)))).alias("citations"),
        F.max(nudge).alias("ml_nudge"))
    return grouped.withColumns({
        "severity": ev.unrank(F.col("severity_rank"), vocab.SEVERITIES),
        "certainty": ev.unrank(F.col("_sure"), vocab.CERTAINTIES),
        "actionable": F.col("penalising") & F.col("issue_class").isin(list(REMEDIATION)),
    }).drop("_sure")


def group_order(groups_alias: str = "") -> list[Column]:
    return [F.col("severity_rank").desc(), F.col("recurrence").desc(), F.col("issue_class").asc(),
            F.col("fact_kind").asc()]


def abstention_summary(abst: DataFrame) -> DataFrame:
    """Counts by reason and by class, and the sessions affected, per capture."""
    axis = F.explode(F.array(
        F.struct(F.lit("reason").alias("axis"), F.col("reason").alias("bucket")),
        F.struct(F.lit("issue_class").alias("axis"), F.col("issue_class").alias("bucket")),
        F.struct(F.lit("total").alias("axis"), F.lit("all").alias("bucket"))))
    return abst.select("capture_id", "stream_key", axis.alias("a")) \
        .groupBy("capture_id", "a.axis", "a.bucket") \
        .agg(F.count(F.lit(1)).alias("abstentions"),
             F.countDistinct("stream_key").alias("affected_sessions"))


def risk_summary(groups: DataFrame, fused: DataFrame) -> DataFrame:
    """Per capture: penalising groups by severity and dimension, groups by kind, reach."""
    pen = F.col("penalising")
    kinds = {"behavioural_deviations": "BEHAVIOURAL_DEVIATION", "anomaly_signals": "ANOMALY_SIGNAL"}
    dims = sorted(set(vocab.CLASS_DIMENSION.values()))
    g = groups.groupBy("capture_id").agg(
        F.count_if(pen).alias("issue_groups"),
        F.max(F.when(pen, F.col("severity_rank"))).alias("_high"),
        *[F.count_if(pen & (F.col("severity") == s)).alias(f"severity_{s.lower()}")
          for s in vocab.SEVERITIES],
        *[F.count_if(pen & (F.col("dimension") == d)).alias(f"dimension_{d.lower()}")
          for d in dims],
        *[F.count_if(F.col("fact_kind") == k).alias(n) for n, k in kinds.items()])
    f = fused.groupBy("capture_id").agg(
        F.countDistinct(F.when(pen, F.col("stream_key"))).alias("affected_sessions"),
        F.count_if(F.col("fact_kind") == "POSITIVE_EVIDENCE").alias("positive_evidence"))
    return g.withColumn("highest_severity", ev.unrank(F.col("_high"), vocab.SEVERITIES)) \
        .drop("_high").join(f, "capture_id")


def _count_state(states: Column, wanted: str) -> Column:
    return F.size(F.filter(states, lambda s: s == wanted))


def coverage(sessions: DataFrame, classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How much of the traffic was assessed, per capture (and per `by`).

    A session counts as assessed when anything was concluded about it, and as abstained only
    when it has abstentions and no conclusion.
    """
    reached = classified.groupBy("capture_id", "stream_key").agg(
        F.bool_or(F.col("fact_kind").isin(CONCLUDING)).alias("concluded"),
        F.bool_or(F.col("fact_kind") == "ABSTENTION").alias("abstained"))
    states = F.array(*[F.col(f"{f}.state") for f in vocab.COVERAGE_FIELDS])
    slim = sessions.select(
        "capture_id", "stream_key", "completeness", "protocol",
        *[_count_state(states, w).alias(f"_{w}") for w in vocab.EVIDENCE_STATES])
    joined = slim.join(reached, ["capture_id", "stream_key"], "left")
    concluded = F.coalesce("concluded", F.lit(False))
    out = joined.groupBy("capture_id", *by).agg(
        F.count(F.lit(1)).alias("sessions_total"),
        F.count_if(concluded).alias("sessions_assessed"),
        F.count_if(~concluded & F.coalesce("abstained", F.lit(False))).alias("sessions_abstained"),
        *[F.sum(f"_{w}").alias(f"state_{w.lower()}") for w in vocab.EVIDENCE_STATES],
        *[F.count_if(F.col("completeness") == c).alias(c.lower())
          for c in ("COMPLETE", "INCOMPLETE", "TRUNCATED")],
        *[F.count_if(F.col("protocol").eqNullSafe(F.lit(p))).alias(f"protocol_{p or 'unidentified'}")
          for p in ("smtp", "imap", "pop3", None)])
    return out.withColumn("assessed_fraction",
                          F.col("sessions_assessed") / F.col("sessions_total"))


def standards_summary(fused: DataFrame) -> DataFrame:
    """Standards each capture's facts rest on, with their sections and cited texts."""
    return (fused.select("capture_id", F.explode("citations").alias("c"))
            .groupBy("capture_id", "c.standard", "c.section", "c.text")
            .agg(F.count(F.lit(1)).alias("uses"))
            .groupBy("capture_id", "standard")
            .agg(F.array_join(F.array_sort(F.collect_set(
                F.when(F.col("section") != "", F.col("section")))), ",").alias("sections"),
                F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses")))


def remediation_summary(groups: DataFrame) -> DataFrame:
    """The groups of a capture that penalise and have guidance, with their position."""
    w = W.partitionBy("capture_id").orderBy(*group_order())
    return groups.filter("actionable").withColumn("position", F.row_number().over(w))


def model_summary(results: DataFrame) -> DataFrame:
    bands = ["ANOMALOUS", "BORDERLINE", "NORMAL", "NOT_SCORED"]
    return results.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("band") != "NOT_SCORED").alias("scored"),
        F.count_if(F.col("band") == "NOT_SCORED").alias("abstained"),
        F.max("threshold").alias("threshold"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in bands])


def provenance(union: DataFrame, fused: DataFrame) -> DataFrame:
    """Per capture: source counts, merged duplicates, contradictions and the rules that spoke."""
    sources = union.groupBy("capture_id").agg(
        F.count_if(F.col("lane") == "DETERMINISTIC").alias("deterministic_findings"),
        F.count_if(F.col("lane") == "CROSS_SESSION").alias("cross_session_findings"),
        F.count_if(F.col("status").isin(ABSTAINING)).alias("abstentions"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rule_ids"))
    merged = fused.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("fused_findings"),
        F.sum("duplicates").alias("duplicate_sources_merged"),
        F.count_if("contradiction").alias("contradictions_recorded"))
    return sources.join(merged, "capture_id")
