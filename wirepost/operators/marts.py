"""Tables behind reports and consoles.  Nothing is rendered here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev


def _axis(df: DataFrame, axes: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("bucket")) for a, c in axes.items()])
    return df.select("capture_id", *keep, F.inline(rows)).filter(F.col("bucket").isNotNull())


def _with_peak(counts: DataFrame) -> DataFrame:
    peak = counts.groupBy("capture_id", "axis").agg(F.max("value").alias("peak"))
    rank = ev.rank(F.col("bucket"), vocab.DISPLAY_SEVERITIES)
    return counts.join(peak, ["capture_id", "axis"]).withColumn(
        "place", F.when(F.col("axis") == "severity", rank).otherwise(0))


def distributions(groups: DataFrame, abst: DataFrame) -> DataFrame:
    """Bars by severity, dimension, kind and abstention reason, with the peak that scales them."""
    pen = F.col("penalising")
    bars = _axis(groups, {"severity": F.when(pen, F.col("severity")), "dimension": F.when(pen, F.col("dimension")),
                          "fact_kind": F.col("fact_kind")})
    every = bars.unionByName(_axis(abst, {"abstention_reason": F.col("reason")}))
    return _with_peak(every.groupBy("capture_id", "axis", "bucket").agg(F.count(F.lit(1)).alias("value")))


def protocol_rows(posture: DataFrame) -> DataFrame:
    return posture.select("capture_id", "protocol", F.col("sessions_total").alias("sessions"), "band",
                          casts.label("posture", F.col("band"), "Not scored").alias("band_label"),
                          casts.posture_tone(F.col("band")).alias("band_tone"),
                          casts.number_text(F.col("value")).alias("score_text"), "abstentions")


def finding_rows(prioritised: DataFrame, fused: DataFrame) -> DataFrame:
    """Ranked groups beside their representative fact, labelled for display."""
    worded = [c for c in ("conclusion", "sources") if c in fused.columns]
    rep = fused.select("capture_id", "issue_class", "fact_kind", F.col("stream_key").alias("representative"), "status",
                       "observability", "protocol", F.col("certainty").alias("_c"), F.col("severity").alias("_s"), *worded)
    joined = prioritised.drop("severity", "certainty").join(
        rep, ["capture_id", "issue_class", "fact_kind", "representative"])
    s, c = F.col("_s"), F.col("_c")
    return joined.withColumns({
        "severity": s, "certainty": c, "severity_marker": casts.severity_marker(s),
        "severity_tone": casts.tone(s), "status_label": casts.label("status", F.col("status")),
        "issue_class_label": casts.humanise(F.col("issue_class")), "fact_kind_label": casts.label("fact_kind", F.col("fact_kind")),
        "protocol_key": F.coalesce("protocol", F.lit(vocab.UNATTRIBUTED)),
        "protocol_label": F.coalesce("protocol", F.lit(vocab.UNATTRIBUTED_LABEL))}).drop("_s", "_c")


def facets(rows: DataFrame) -> DataFrame:
    """Filter options of eight facets with their counts; severity keeps vocabulary order."""
    names = ["severity", "status", "certainty", "observability", "fact_kind", "issue_class", "dimension"]
    axes = {**{n: F.col(n) for n in names}, "protocol": F.col("protocol_key")}
    counts = _axis(rows, axes).groupBy("capture_id", "axis", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.when(F.col("axis") == "severity", ev.rank(F.col("bucket"), vocab.DISPLAY_SEVERITIES)).otherwise(0))


def group_rows(groups: DataFrame) -> DataFrame:
    return groups.select("capture_id", "issue_class", casts.humanise(F.col("issue_class")).alias("issue_class_label"), "severity",
                         casts.severity_marker(F.col("severity")).alias("marker"),
                         casts.label("fact_kind", F.col("fact_kind")).alias("fact_kind_label"),
                         casts.label("dimension", F.col("dimension")).alias("dimension_label"), "recurrence", "penalising")


def abstention_rows(abst: DataFrame) -> DataFrame:
    return abst.select("capture_id", "stream_key", "rule_id", casts.label("abstention_reason", F.col("reason")).alias("reason_label"),
                       casts.humanise(F.col("issue_class")).alias("issue_class_label"),
                       F.coalesce("protocol", F.lit(vocab.UNATTRIBUTED_LABEL)).alias("protocol_label"), "why")


def report_summary(score: DataFrame, cov: DataFrame, groups: DataFrame, abst: DataFrame) -> DataFrame:
    """The opening block of a report, one row per capture."""
    g = groups.groupBy("capture_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if("penalising").alias("penalising"),
                                         F.max(F.when(F.col("penalising"), F.col("severity_rank"))).alias("_w"))
    a = abst.groupBy("capture_id").agg(F.count(F.lit(1)).alias("abstentions"))
    s = score.select("capture_id", "band", "value")
    joined = s.join(cov, "capture_id").join(g, "capture_id", "left").join(a, "capture_id", "left")
    return joined.select(
        "capture_id", casts.label("posture", F.col("band")).alias("posture"),
        F.concat(casts.number_text(F.col("value")), F.lit(" / 100")).alias("score_text"),
        F.concat(casts.percent_text(F.col("assessed_fraction")), F.lit(" ("), F.col("sessions_assessed").cast("string"), F.lit(" of "),
                 F.col("sessions_total").cast("string"), F.lit(" sessions assessed)")).alias("coverage_text"),
        F.concat(F.coalesce("groups", F.lit(0)).cast("string"), F.lit(" total · "), F.coalesce("penalising", F.lit(0)).cast("string"),
                 F.lit(" penalising the score")).alias("groups_text"),
        ev.unrank(F.col("_w"), vocab.SEVERITIES).alias("highest_severity"), F.coalesce("abstentions", F.lit(0)).alias("abstentions"))


def report_prioritised(prioritised: DataFrame) -> DataFrame:
    """All ranks of a capture, with how many there are; paging is the reader's."""
    totals = prioritised.groupBy("capture_id").agg(F.count(F.lit(1)).alias("of"))
    return prioritised.join(totals, "capture_id").select(
        "capture_id", "rank", F.concat(casts.severity_marker(F.col("severity")), F.lit(" "), F.col("severity")).alias("severity"),
        casts.humanise(F.col("issue_class")).alias("issue"), F.col("recurrence").alias("sessions"),
        casts.number_text(F.col("priority_score")).alias("priority"), "of")


def report_issues(groups: DataFrame, prioritised: DataFrame, frames: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Groups with the first ranked representative of their class and its frames.

    `frames` has capture_id, stream_key, frame_number.  `frames` of the result is the whole list of
    the evidence of one session, `frame_text` a short form of it, `title_text` one of the title.  A null
    representative of a ranked class is the group of packets outside streams and has that group's frames.
    Groups without their titles give rows without them.
    """
    rep = prioritised.groupBy("capture_id", "issue_class").agg(F.min_by("representative", "rank").alias("representative")) \
        .withColumn("_key", F.coalesce("representative", F.lit("None")))
    out = groups.drop("representative").join(rep, ["capture_id", "issue_class"], "left")
    if frames is not None:
        keyed = frames.withColumn("_key", F.coalesce("stream_key", F.lit("None")))
        lists = keyed.join(rep.select("capture_id", "_key").distinct(), ["capture_id", "_key"], "left_semi").groupBy("capture_id", "_key") \
            .agg(F.sort_array(F.collect_set("frame_number")).alias("frames"))
        n = F.size("frames")
        head = F.array_join(F.transform(F.slice("frames", 1, limit), lambda f: f.cast("string")), ", ")
        text = F.when(n > limit, F.concat(head, F.lit(", … ("), n.cast("string"), F.lit(" total)"))).otherwise(head)
        out = out.join(lists.withColumn("frame_text", text), ["capture_id", "_key"], "left")
    out = out.drop("_key")
    return out.withColumn("title_text", casts.clip(F.col("title"))) if "title" in out.columns else out


NO_VALUE = "—"


def value_text(col: Column, kind: str) -> Column:
    """A value as a report shows it; a missing one is a dash."""
    text = F.when(col, "Yes").otherwise("No") if kind == "boolean" else casts.number_text(col) if kind == "double" \
        else F.array_join(col, ", ") if kind.startswith("array") else col.cast("string")
    return F.when(col.isNull() | (text == ""), F.lit(NO_VALUE)).otherwise(text)


def report_tables(documents: DataFrame) -> DataFrame:
    """Every table of a report as (table, row, column, value), from the nested record alone.

    The records of a list become its rows, in their order.  Scalar fields become a row each of the
    columns Item and Value; so does a field of a summary for which no table is set out here.  One scan:
    the cells are an array of the record, which is bounded, and no row leaves its task.
    """
    schema = documents.schema

    def cell(table: str, row: Column, column: str, value: Column) -> Column:
        return F.struct(F.lit(table).alias("table"), row.cast("int").alias("row"), F.lit(column).alias("column"), value.alias("value"))

    def rows_of(table: str, field: str, columns: dict) -> Column:
        kinds = {f.name: f.dataType.simpleString() for f in schema[field].dataType.elementType.fields}

        def cells(r, i):
            shown = {title: (spec, None) if isinstance(spec, str) else spec for title, spec in columns.items()}
            return F.array(*[cell(table, i, title, value_text(show(r[name]) if show else r[name], "string" if show else kinds[name]))
                             for title, (name, show) in shown.items()])
        return F.flatten(F.transform(F.col(field), cells))

    def items_of(table: str, field: str, wanted=None) -> Column:
        kinds = {f.name: f.dataType.simpleString() for f in schema[field].dataType.fields}
        names = [n for n in sorted(kinds) if wanted is None or wanted(n)]
        out = []
        for i, n in enumerate(names):
            out += [cell(table, F.lit(i), "Item", casts.humanise(F.lit(n))), cell(table, F.lit(i), "Value", value_text(F.col(field)[n], kinds[n]))]
        return F.array(*out)

    plain, reason, posture = casts.humanise, lambda c: casts.label("abstention_reason", c), lambda c: casts.label("posture", c, "Not scored")
    spaced = lambda c: F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(","), F.lit(", "))
    by_protocol, by_state = lambda n: n.startswith("protocol_"), lambda n: n.startswith("state_")
    complete = lambda n: n in ("complete", "incomplete", "truncated")
    tables = [
        items_of("scope", "coverage", by_protocol),
        items_of("score", "score"),
        rows_of("penalties", "components", {"Issue class": ("issue_class", plain), "Severity": "severity", "Recurrence": "recurrence",
                                            "Weight": "base_weight", "Recurrence multiplier": "recurrence_multiplier", "Penalty": "penalty"}),
        items_of("coverage", "coverage", lambda n: not (by_protocol(n) or by_state(n) or complete(n))),
        items_of("evidence_states", "coverage", by_state), items_of("completeness", "coverage", complete),
        rows_of("protocol_posture", "protocol_posture", {
            "Protocol": "protocol", "Sessions": "sessions_total", "Band": ("band", posture), "Score": "value",
            "Dimensions assessed": ("dimensions_assessed", spaced), "Not observable": ("dimensions_not_observable", spaced),
            "Abstentions": "abstentions"}),
        rows_of("standards", "standards_summary", {"Standard": "standard", "Citations": "uses", "Sections": "sections"}),
        rows_of("remediation", "remediation_summary", {
            "Observed": "observed", "Why it matters": "why_it_matters", "Recommended action": "recommended_action",
            "Sessions": "recurrence", "Verification": "verification", "Standard": "standards"}),
        rows_of("abstentions", "abstentions", {
            "Reason": ("reason", reason), "Issue class": ("issue_class", plain), "Could not conclude": "what_could_not_be_concluded",
            "Would be resolved by": "resolved_by", "Protocol": "protocol", "Sessions": "sessions"}),
        items_of("risk", "risk_summary"), items_of("provenance", "provenance")]
    cells = F.flatten(F.array(*[F.coalesce(t, F.array()) for t in tables]))
    return documents.select("capture_id", F.inline(cells))


def evidence_matrix(sessions: DataFrame) -> DataFrame:
    """Per field: distinct signatures, the strict-majority one, and the sessions that diverge."""
    sig = lambda f: F.concat(F.col(f"{f}.state"), F.lit("|"), F.coalesce(f"{f}.value", F.lit("")))
    fields = [f for f in vocab.EVIDENCE_FIELDS if f in sessions.columns]
    counts = _axis(sessions, {f: sig(f) for f in fields}).groupBy("capture_id", "axis", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("capture_id", F.col("axis").alias("field")).agg(
        F.count(F.lit(1)).alias("signatures"), F.sum("n").alias("sessions"), F.max("n").alias("top"), F.max_by("bucket", "n").alias("_b")) \
        .withColumns({"majority": F.when(F.col("top") * 2 > F.col("sessions"), F.col("_b")),
                      "divergent": F.when(F.col("top") * 2 > F.col("sessions"), F.col("sessions") - F.col("top")).otherwise(0)}).drop("_b", "top")


def side_facts(sessions: DataFrame) -> DataFrame:
    """Upgrade, TLS and cleartext-login counts per client."""
    adv = F.coalesce(F.col("starttls_advertised.value") == "true", F.lit(False))
    auth = F.coalesce(F.col("auth_activity.value") == "true", F.lit(False))
    tls = ~F.upper("tls_state").isin("NONE", "UNKNOWN", "")
    return sessions.groupBy("capture_id", "client_ip").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(adv).alias("starttls"), F.count_if(tls).alias("tls"),
        F.count_if(auth & ~adv & (F.upper("tls_state") == "NONE")).alias("plaintext_auth"))


def timeline(events: DataFrame, evidence: DataFrame, transitions: DataFrame) -> DataFrame:
    """Events, evidence and transitions of a session in frame order.

    All three carry capture_id, tcp_stream_id, frame_number, title.  A transition on the frame of
    an event is not repeated, but lends the event its time.
    """
    key = ["capture_id", "tcp_stream_id", "frame_number"]
    times = transitions.groupBy(*key).agg(F.min("time").alias("time"))
    ev_rows = events.select(*key, "title").join(times, key, "left").withColumn("step", F.lit("event"))
    tr_rows = transitions.join(events.select(*key).distinct(), key, "left_anti").select(*key, "title", "time").withColumn("step", F.lit("transition"))
    fields = evidence.select(*key, "title").withColumns({"time": F.lit(None).cast("double"), "step": F.lit("evidence")})
    return ev_rows.unionByName(fields).unionByName(tr_rows).withColumn(
        "place", F.when(F.col("step") == "event", 0).when(F.col("step") == "evidence", 1).otherwise(2))


def state_chips(findings: DataFrame) -> DataFrame:
    """Findings that cite at least one field in each evidence state."""
    states = F.explode(F.array_distinct(F.transform("evidence_refs", lambda r: r["evidence_state"])))
    return findings.select("capture_id", states.alias("state")).groupBy("capture_id", "state").agg(F.count(F.lit(1)).alias("findings"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """One row per known severity, zero included, and the unrated rest."""
    level = F.upper("severity")
    known = F.when(level.isin(vocab.DISPLAY_SEVERITIES), level).otherwise("UNRATED")
    counts = rows.groupBy("capture_id", known.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    full = rows.select("capture_id").distinct().select(
        "capture_id", F.explode(F.array(*[F.lit(s) for s in [*vocab.DISPLAY_SEVERITIES, "UNRATED"]])).alias("level"))
    return full.join(counts, ["capture_id", "level"], "left").fillna({"n": 0})


def search(text: str, findings: DataFrame, sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Case-insensitive substring search over titles and subtitles of all three."""
    hit = F.lower(F.concat_ws(" ", "title", "subtitle", "category")).contains(text.strip().lower())
    rows = findings.select(F.lit("Findings").alias("category"), F.col("title"), F.concat_ws(" · ", "severity", "rule_id").alias("subtitle")) \
        .unionByName(sessions.select(F.lit("Sessions").alias("category"), F.concat_ws(" ", "protocol", "client_ip", "server_ip").alias("title"),
                                     F.concat(F.col("packet_count").cast("string"), F.lit(" packets")).alias("subtitle"))) \
        .unionByName(runs.filter(F.col("state") == "COMPLETED").select(F.lit("Analyses").alias("category"), F.col("source_filename").alias("title"),
                                                                      F.col("overall_posture").alias("subtitle")))
    return rows.filter(hit)
