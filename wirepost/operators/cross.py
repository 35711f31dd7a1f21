"""Comparing a session with its own prior history and with other clients of the same server."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev
from wirepost.operators import rules, skew
from wirepost.plans.lineage import hinted, written

ENDPOINT = ["capture_id", "server_ip", "server_port", "protocol", "implicit_tls"]
CLIENT_KEY = ["capture_id", "client_ip", "server_ip", "server_port", "protocol", "implicit_tls"]
FEATURES = ["starttls_advertised", "starttls_requested", "tls_established", "tls_version",
            "auth_activity"]
ORDER = ["_epoch", "_frame", "_stream"]
HOUR, FRAME_RANGE, BEFORE_TIME = 3600, 65_536, -10**12
#: sessions of one client key that a single task may hold
LONG_KEY = 1 << 20


@dataclass(frozen=True)
class CrossConfig:
    min_history: int = 5
    max_history: int = 50
    min_controls: int = 1
    rules: list = field(default_factory=lambda: list(DEFAULT_CROSS_RULES))


# --------------------------------------------------------------------------- comparability
def comparability() -> Column:
    resolved = F.lit(True)
    for c in ("client_ip", "server_ip", "server_port"):
        resolved = resolved & F.col(c).isNotNull()
    return (F.when(F.col("protocol").isNull(), "NOT_COMPARABLE")
            .when(~resolved | (F.col("completeness") == "TRUNCATED"), "INSUFFICIENT_EVIDENCE")
            .otherwise("COMPARABLE"))


def assess(sessions: DataFrame) -> DataFrame:
    """May this session take part in cross-session reasoning at all?"""
    return sessions.withColumn("comparability", comparability())


def population_index(sessions: DataFrame) -> DataFrame:
    """Sizes per client key and per endpoint, with the distinct clients of each endpoint."""
    pop = assess(sessions).filter(F.col("comparability") == "COMPARABLE")
    per_key = pop.groupBy(*CLIENT_KEY).agg(F.count(F.lit(1)).alias("sessions"))
    rolled = per_key.groupingSets([[F.col(c) for c in CLIENT_KEY], [F.col(c) for c in ENDPOINT]],
                                  *[F.col(c) for c in CLIENT_KEY])
    # one row per client key enters, so counting rows counts distinct clients
    return rolled.agg(
        F.when(F.grouping("client_ip") == 1, "endpoint").otherwise("client").alias("level"),
        F.sum("sessions").alias("sessions"), F.count(F.lit(1)).alias("clients"))


def comparable_pairs(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Verdict for given pairs (`a_key`, `b_key`) of stream keys."""
    s = assess(sessions).select("stream_key", "comparability", *CLIENT_KEY[1:])
    side = lambda p: s.select(*[F.col(c).alias(f"{p}_{c}") for c in s.columns]) \
        .withColumnRenamed(f"{p}_stream_key", f"{p}_key")
    both = pairs.join(side("a"), "a_key").join(side("b"), "b_key")
    same = F.lit(True)
    for c in CLIENT_KEY[1:]:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    a, b = F.col("a_comparability"), F.col("b_comparability")
    return both.select("a_key", "b_key", F.when(a != "COMPARABLE", a).when(b != "COMPARABLE", b)
                       .when(~same, "NOT_COMPARABLE").otherwise("COMPARABLE").alias("result"))


# -------------------------------------------------------------------------- prior history
def feature_columns() -> dict[str, Column]:
    """The five baselined features as text, value first."""
    established = F.col("tls_state") == "ESTABLISHED"
    return {
        "starttls_advertised": ev.reading("starttls_advertised"),
        "starttls_requested": ev.reading("starttls_requested"),
        "tls_established": F.when(established, "true").otherwise(F.col("tls_state")),
        "tls_version": ev.reading("tls_negotiated_version"),
        "auth_activity": ev.reading("auth_activity"),
    }


def with_order(df: DataFrame) -> DataFrame:
    """Total session order: time (missing first), then frame, then stream."""
    return df.withColumns({
        "_epoch": F.coalesce("start_epoch", F.lit(float("-inf"))),
        "_frame": F.coalesce("first_frame", F.lit(-1)),
        "_stream": F.coalesce("tcp_stream_id", F.lit(-1))})


def history_chunks(sessions: DataFrame, lookback: int, long_key: int = LONG_KEY) -> DataFrame:
    """Comparable sessions cut into bounded chunks of their client key, so a look-back window over
    (key, chunk) is exact however many sessions one key has.

    A key of up to `long_key` sessions is one chunk: it travels once, for the window.  Only the sessions of
    longer keys, of which there are few enough to be sent to every task, are numbered and cut.
    """
    sized = with_order(sessions).dropna(subset=CLIENT_KEY)
    counts = sized.groupBy(*CLIENT_KEY).agg(F.count(F.lit(1)).alias("_size"))
    long = F.broadcast(counts.filter(F.col("_size") > long_key).select(*CLIENT_KEY))
    whole = sized.join(long, CLIENT_KEY, "left_anti").withColumns({c: F.lit(0).cast("bigint") for c in ("_n", "_home", "_chunk")})
    block = F.when(F.col("start_epoch").isNull(),
                   F.floor(F.coalesce("first_frame", F.lit(0)) / FRAME_RANGE) + BEFORE_TIME) \
        .otherwise(F.floor(F.col("start_epoch") / HOUR))
    numbered = skew.ordinals(sized.join(long, CLIENT_KEY, "left_semi").withColumn("_block", block), CLIENT_KEY, "_block", ORDER, "_n")
    return whole.unionByName(skew.chunked(numbered.drop("_block"), CLIENT_KEY, "_n", lookback))


def _history_window(max_history: int):
    return W.partitionBy(*CLIENT_KEY, "_chunk").orderBy(*ORDER, "_n").rowsBetween(-max_history, -1)


def prior_history(sessions: DataFrame, max_history: int = 50) -> DataFrame:
    """Per session: how many prior comparable sessions count, and the span they cover."""
    pop = assess(sessions).filter(F.col("comparability") == "COMPARABLE")
    w = _history_window(max_history)
    out = history_chunks(pop, max_history).withColumns({
        "prior_count": F.count(F.lit(1)).over(w),
        "window_start_epoch": F.min("start_epoch").over(w),
        "window_end_epoch": F.max("start_epoch").over(w)})
    return skew.own_rows(out).drop(*ORDER, "_n")


def baseline_columns(max_history: int, dominant: bool) -> dict[str, Column]:
    w = _history_window(max_history)
    out = {"prior_count": F.count(F.lit(1)).over(w),
           "window_start_epoch": F.min("start_epoch").over(w),
           "window_end_epoch": F.max("start_epoch").over(w),
           "upgrades": F.sum((F.col("feature_tls_established") == "true").cast("int")).over(w)}
    for f in FEATURES:
        lo, hi = F.min(f"feature_{f}").over(w), F.max(f"feature_{f}").over(w)
        out[f"expected_{f}"] = F.when(lo == hi, lo)
        if dominant:
            out[f"dominant_{f}"] = F.mode(f"feature_{f}", True).over(w)
    return out


def build_baseline(sessions: DataFrame, min_history: int = 5, max_history: int = 50,
                   dominant: bool = False) -> DataFrame:
    """Every session with its baseline.

    `expected_<feature>` is set where the whole history agreed, `dominant_<feature>` is the most
    frequent value (smallest on a tie).  Sessions that may not be compared keep nulls.
    """
    featured = assess(sessions).withColumns(
        {f"feature_{k}": c for k, c in feature_columns().items()})
    pop = featured.filter(F.col("comparability") == "COMPARABLE")
    rest = featured.filter(F.col("comparability") != "COMPARABLE")
    windowed = history_chunks(pop, max_history).withColumns(
        baseline_columns(max_history, dominant))
    windowed = skew.own_rows(windowed).drop(*ORDER, "_n")
    out = windowed.unionByName(rest, allowMissingColumns=True)
    n = F.coalesce("prior_count", F.lit(0))
    status = (F.when(F.col("comparability") == "NOT_COMPARABLE", "NOT_APPLICABLE")
              .when((F.col("comparability") != "COMPARABLE") | (n < min_history),
                    "INSUFFICIENT_HISTORY").otherwise("ESTABLISHED"))
    usable = F.col("baseline_status") == "ESTABLISHED"
    blank = [f"{p}_{f}" for f in FEATURES for p in (("expected", "dominant") if dominant
                                                   else ("expected",))]
    return (out.withColumns({"prior_count": n, "baseline_status": status})
            .withColumns({
                "baseline_rate": F.when(usable, F.col("upgrades") / F.col("prior_count")),
                "window_start_epoch": F.when(usable, F.col("window_start_epoch")),
                "window_end_epoch": F.when(usable, F.col("window_end_epoch")),
                **{c: F.when(usable, F.col(c)) for c in blank}})
            .drop("upgrades"))


def baseline_members(sessions: DataFrame, max_history: int = 50) -> DataFrame:
    """One row per session and prior session: the members a baseline rests on."""
    pop = assess(sessions).filter(F.col("comparability") == "COMPARABLE")
    w = _history_window(max_history)
    member = F.struct("stream_key", "tcp_stream_id", "first_frame", "start_epoch")
    out = skew.own_rows(history_chunks(pop, max_history)
                        .withColumn("_m", F.collect_list(member).over(w)))
    return out.select(F.col("stream_key").alias("subject"), F.explode("_m").alias("m")) \
        .select("subject", F.col("m.stream_key").alias("member"),
                F.col("m.start_epoch").alias("member_epoch"))


def feature_summary(sessions: DataFrame, max_history: int = 50) -> DataFrame:
    """Value counts of each feature over a session's prior history, in long form."""
    pop = assess(sessions).filter(F.col("comparability") == "COMPARABLE") \
        .withColumns({f"feature_{k}": c for k, c in feature_columns().items()})
    w = _history_window(max_history)
    values = F.struct(*[F.col(f"feature_{f}").alias(f) for f in FEATURES])
    hist = skew.own_rows(history_chunks(pop, max_history)
                         .withColumn("_h", F.collect_list(values).over(w)))
    long = hist.select("stream_key", F.size("_h").alias("total"), F.explode("_h").alias("v"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"v.{f}").alias("value"))
                      for f in FEATURES])
    counts = (long.select("stream_key", "total", F.explode(pairs).alias("p"))
              .groupBy("stream_key", "total", "p.feature", "p.value")
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("stream_key", "feature").agg(
        F.max("total").alias("total"), F.count(F.lit(1)).alias("distinct_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("dominant"),
        F.max("n").alias("dominant_count"),
        F.sum(F.when(F.col("value") == "true", F.col("n")).otherwise(0)).alias("true_count"))


# -------------------------------------------------------------------------- other clients
def endpoint_controls(sessions: DataFrame, max_controls: int = 50) -> DataFrame:
    """Per endpoint, the control evidence every client of it would see.

    A client's controls are the newest sessions of *other* clients.  Keeping the newest
    `max_controls` of each client and of those the newest `2 * max_controls` of the endpoint is
    enough: one client can hide at most `max_controls` of them from itself.  Both cuts are top-k
    windows, so they are applied before the shuffle, and an endpoint ends as one bounded row.
    """
    pop = with_order(assess(sessions).filter(F.col("comparability") == "COMPARABLE"))
    newest = [F.col(c).desc() for c in ORDER]
    slim = pop.select(*CLIENT_KEY, *ORDER, (F.col("tls_state") == "ESTABLISHED").alias("up"))
    per_client = slim.withColumn("_r", F.row_number().over(
        W.partitionBy(*CLIENT_KEY).orderBy(*newest))).filter(F.col("_r") <= max_controls)
    pool = per_client.withColumn("_e", F.row_number().over(
        W.partitionBy(*ENDPOINT).orderBy(*newest))).filter(F.col("_e") <= 2 * max_controls)
    rows = F.array_sort(F.collect_list(F.struct("_e", "client_ip", "up")))
    by_endpoint = pool.groupBy(*ENDPOINT).agg(rows.alias("_rows"))

    def tally(picked: Column) -> Column:
        top = F.slice(picked, 1, max_controls)
        return F.struct(F.size(top).alias("n"), F.size(F.filter(top, lambda r: r["up"])).alias("up"))

    clients = F.array_distinct(F.transform("_rows", lambda r: r["client_ip"]))
    own = F.map_from_entries(F.transform(clients, lambda c: F.struct(
        c.alias("client"),
        tally(F.filter("_rows", lambda r: r["client_ip"] != c)).alias("seen"))))
    return by_endpoint.select(*ENDPOINT, own.alias("_own"), tally(F.col("_rows")).alias("_any"))


def find_controls(sessions: DataFrame, max_controls: int = 50, population: DataFrame | None = None) -> DataFrame:
    """Every session with the number of control sessions and how many of them upgraded.

    `population` has the same sessions without what was worked out of them.  The row of an endpoint is written
    once; with few endpoints it is sent to every task and no session travels to meet it.
    """
    assessed = sessions if "comparability" in sessions.columns else assess(sessions)
    controls = hinted(written(endpoint_controls(sessions if population is None else population, max_controls)))
    joined = assessed.join(controls, ENDPOINT, "left")
    seen = F.coalesce(F.col("_own")[F.col("client_ip")], F.col("_any"))
    ok = F.col("comparability") == "COMPARABLE"
    return joined.withColumns({
        "control_count": F.when(ok, F.coalesce(seen["n"], F.lit(0))).otherwise(0),
        "controls_upgraded": F.when(ok, F.coalesce(seen["up"], F.lit(0))).otherwise(0),
    }).drop("_own", "_any")


def evaluate_contrast(sessions: DataFrame, min_controls: int = 1, max_controls: int = 50,
                      population: DataFrame | None = None) -> DataFrame:
    found = find_controls(sessions, max_controls, population)
    n, up = F.col("control_count"), F.col("controls_upgraded")
    not_applicable = (F.col("comparability") != "COMPARABLE") | F.col("implicit_tls") | (n == 0)
    state = (F.when(not_applicable, "CONTRAST_NOT_APPLICABLE")
             .when(n < min_controls, "CONTRAST_INSUFFICIENT")
             .when((up > 0) & (up < n), "CONTRAST_AMBIGUOUS")
             .otherwise("CONTRAST_SUPPORTED"))
    rated = F.col("contrast_state").isin("CONTRAST_AMBIGUOUS", "CONTRAST_SUPPORTED")
    return (found.withColumn("contrast_state", state)
            .withColumns({
                "control_count": F.when(F.col("contrast_state") == "CONTRAST_NOT_APPLICABLE", 0)
                .otherwise(n),
                "control_rate": F.when(rated, up / n),
                "subject_upgraded": F.when(rated, F.col("tls_state") == "ESTABLISHED")})
            .drop("controls_upgraded"))


def cross_context(sessions: DataFrame, config: CrossConfig | None = None,
                  dominant: bool = False) -> DataFrame:
    """Sessions with comparability, baseline and contrast.  The states that the rules consult come along as one
    number, so that a reader of states alone does not carry the evidence through the windows."""
    config = config or CrossConfig()
    consulted = _consulted_fields(config.rules)
    if all(f in sessions.columns for f in consulted):
        sessions = sessions.withColumn(_states_name(consulted), ev.packed_states(consulted))
    based = build_baseline(sessions, config.min_history, config.max_history, dominant)
    return evaluate_contrast(based, config.min_controls, config.max_history, sessions)


# ---------------------------------------------------------------------------------- rules
# fixed values: standards and wording of the comparison rules
RFC3207 = "RFC 3207 §6 (SMTP STARTTLS security considerations)"
TLS_STANDARDS = ["RFC 8996 (BCP 195)", "NIST SP 800-52r2 §3.1"]
# end of fixed values


@dataclass(frozen=True)
class CrossRule:
    """`ladder` gives (condition, status, severity, deviation, conclusion)."""

    rule_id: str
    title: str
    standards: list
    refs: list[str]
    applies: Callable[[], Column]
    ladder: Callable[[], list[tuple]]


def _usable() -> Column:
    return F.col("baseline_status") == "ESTABLISHED"


def _abstain() -> list[tuple]:
    return [
        (F.col("baseline_status") == "NOT_APPLICABLE", "NOT_OBSERVABLE", "INFO", "NOT_ASSESSED",
         "Cross-session comparison does not apply to this session."),
        (~_usable(), "INSUFFICIENT_EVIDENCE", "INFO", "NOT_ASSESSED",
         "Insufficient comparable history to assess this session."),
    ]


def _advertisement() -> list[tuple]:
    expected, now = F.col("expected_starttls_advertised"), F.col("feature_starttls_advertised")
    others_upgrade = (F.col("contrast_state") == "CONTRAST_SUPPORTED") & (F.col("control_rate") == 1)
    same = now == expected
    return _abstain() + [
        (expected.isNull(), "AMBIGUOUS", "INFO", "NOT_ASSESSED",
         "Historical advertisement behaviour is not consistent."),
        (same & others_upgrade & ~F.col("subject_upgraded") & (now != "true"),
         "OBSERVED_ISSUE", "MEDIUM", "SUSPICIOUS_DEVIATION",
         "This endpoint consistently lacks the upgrade capability while comparable endpoints at "
         "the same server consistently have it."),
        (same, "COMPLIANT", "INFO", "NONE",
         "Advertisement behaviour matches the established baseline."),
        (others_upgrade, "OBSERVED_ISSUE", "MEDIUM", "SUSPICIOUS_DEVIATION",
         "This endpoint deviates from both its own history and from comparable endpoints that "
         "remain unaffected."),
        (F.lit(True), "AMBIGUOUS", "INFO", "DEVIATION",
         "This session deviates from its own history; the cause is undetermined."),
    ]


def _upgrade() -> list[tuple]:
    return _abstain() + [
        (F.col("expected_tls_established") != F.col("feature_tls_established"),
         "AMBIGUOUS", "INFO", "DEVIATION",
         "Upgrade outcome differs from the established baseline."),
    ]


def _version() -> list[tuple]:
    # a reading without a value is its state, which is no version and has no rank
    expected, now = F.col("expected_tls_version"), F.col("feature_tls_version")
    ordered = list(vocab.VERSION_RANK)
    old, new = ev.rank(expected, ordered), ev.rank(now, ordered)

    def moved(word):
        return F.concat(F.lit(f"Negotiated version {word} from "), expected, F.lit(" to "), now,
                        F.lit("."))
    return [
        (_usable() & (new > old), "INFORMATIONAL", "INFO", "NONE", moved("improved")),
        (_usable() & (new < old), "OBSERVED_ISSUE", "MEDIUM", "DEVIATION", moved("regressed")),
    ]


def _upgradable() -> Column:
    return ~F.col("implicit_tls") & F.col("protocol").isNotNull()


DEFAULT_CROSS_RULES = [
    CrossRule("CS-STARTTLS-001", "STARTTLS/STLS advertisement deviation from baseline", [RFC3207],
              ["starttls_advertised"], _upgradable, _advertisement),
    CrossRule("CS-STARTTLS-002", "STARTTLS/STLS upgrade deviation from baseline", [RFC3207],
              ["tls_transition", "starttls_requested"], _upgradable, _upgrade),
    CrossRule("CS-TLS-001", "Negotiated TLS version deviation from baseline", TLS_STANDARDS,
              ["tls_negotiated_version"], lambda: F.lit(True), _version),
]


ABSTAINING = "starttls_advertised"


def _consulted_fields(cross_rules: list[CrossRule]) -> list[str]:
    return list(dict.fromkeys([ABSTAINING, *[f for r in cross_rules for f in r.refs]]))


def _states_name(fields: list[str]) -> str:
    return "_states_" + "_".join(fields)


def _outcome(rule: CrossRule, seq: int) -> Column:
    return F.struct(F.lit(seq).alias("seq"), rules.pick(
        rule.ladder(), rule.applies(), ("status", "severity", "deviation", "conclusion")).alias("o"))


def cross_findings(context: DataFrame, cross_rules: list[CrossRule] | None = None) -> DataFrame:
    """Findings of the comparison rules over sessions with context."""
    cross_rules = DEFAULT_CROSS_RULES if cross_rules is None else cross_rules
    kept = ["capture_id", "tcp_stream_id", "stream_key", "protocol", "baseline_status", "prior_count",
            "contrast_state", "control_count", "control_rate"]
    fields = _consulted_fields(cross_rules)
    states = F.col(_states_name(fields)) if _states_name(fields) in context.columns else ev.packed_states(fields)
    judged = context.select(*kept, states.alias("_states"), F.array(*[rules.ref(f) for f in fields]).alias("_refs"),
                            F.array(*[_outcome(r, 100 + i) for i, r in enumerate(cross_rules)]).alias("_outcomes"))
    number = F.col("seq") - 100
    wanted = [one for r in cross_rules for one in ([ABSTAINING], r.refs)]
    which = number * 2 + F.coalesce(_usable(), F.lit(False)).cast("int")
    refs = rules.refs_of("_refs", fields, wanted, which)
    rule_id = rules.by_number([r.rule_id for r in cross_rules], number)
    return (judged.select(*kept, "_refs", "_states", F.inline_outer("_outcomes")).filter(F.col("o").isNotNull())
            .select(casts.finding_id(rule_id, F.col("capture_id"),
                                     F.col("tcp_stream_id"), F.col("o.status"),
                                     F.col("o.deviation")).alias("finding_id"),
                    "seq", rule_id.alias("rule_id"),
                    rules.by_number([r.title for r in cross_rules], number).alias("title"),
                    "o.status", "o.severity", "o.deviation", "o.conclusion",
                    rules.by_number([list(r.standards) for r in cross_rules], number).alias("standards"),
                    refs.alias("evidence_refs"), *kept,
                    ev.bits_of_packed(F.col("_states"), fields, wanted, which).alias("evidence_states")))


def cross_report(context: DataFrame, findings: DataFrame) -> DataFrame:
    """Per capture: sessions, established baselines, abstentions and findings by deviation."""
    sessions = context.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("sessions_analysed"),
        F.count_if(_usable()).alias("baselines_established"),
        F.count_if(~_usable()).alias("abstentions"))
    kinds = ["NONE", "DEVIATION", "SUSPICIOUS_DEVIATION", "NOT_ASSESSED"]
    counts = findings.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("deviation") == k).alias(k.lower()) for k in kinds])
    return sessions.join(counts, "capture_id", "left").withColumn(
        "abstention_rate", F.round(F.col("abstentions") / F.col("sessions_analysed"), 4))
