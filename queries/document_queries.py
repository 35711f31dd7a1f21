"""The nested assessment record, written and read back, and the report tables made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import lifts
from queries import posture_queries as pq
from queries.base import lit, query
from queries.mart_queries import human_sql, label_sql
from wirepost.operators import fusion, marts
from wirepost.plans import assessment, document, lineage
from wirepost.sources import catalog

_PROTO = pq.PROTO_SQL[len(f"WITH {pq.U}, {pq.FU}, "):]
_RESOLVED = f"CASE {pq.REASON} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fusion.RESOLUTION.items()) + " END"
#: every part of the record as a table of its own
PARTS = f"""{pq.SCORE_SQL}, {pq.AID}, {pq.PROV}, {pq.PRI}, {_PROTO}, {pq._REM},
  ac AS (SELECT capture_id, {pq.REASON} AS reason, issue_class, rule_id, protocol, min(title) AS what, min({_RESOLVED}) AS resolved, count(*) AS abstentions, count(DISTINCT stream_key) AS sessions
    FROM kl WHERE fact_kind = 'ABSTENTION' GROUP BY ALL),
  rp AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sr DESC, recurrence DESC, issue_class, fact_kind) AS position FROM gr WHERE actionable),
  st AS (SELECT capture_id, standard, CASE standard WHEN 'RFC 8996 (BCP 195)' THEN 'SS4-5' WHEN 'NIST SP 800-52r2' THEN 'SS3.1' WHEN 'RFC 3207' THEN 'SS6' WHEN 'RFC 8314' THEN 'SS3' ELSE '' END AS sections
    FROM (SELECT DISTINCT capture_id, unnest(string_split(standards, ',')) AS standard FROM fu))"""


def made_documents(spark, sf):
    made = assessment.run(spark, lifts.sessions(spark, sf, with_certificates=True))
    return document.documents(made, run_id="run-1", generated_at="2024-01-01T00:00:00Z")


@query("assessment_document", f"""{PARTS}
  SELECT sc.capture_id, 'score' AS section, assessment_id AS name, band AS part, sessions_assessed AS n, CAST(round(v, 2) AS DOUBLE) AS value FROM sc JOIN aid USING (capture_id)
  UNION ALL SELECT capture_id, 'group', issue_class, fact_kind || '|' || severity || '|' || certainty || '|' || protocols, recurrence, finding_count FROM gr
  UNION ALL SELECT capture_id, 'priority', issue_class, fact_kind || '|' || representative, rank, round(priority_score, 2) FROM pri
  UNION ALL SELECT capture_id, 'penalty', issue_class, fact_kind || '|' || severity, recurrence, round(penalty, 2) FROM cp
  UNION ALL SELECT capture_id, 'protocol', protocol, band || '|' || issue_classes || '|' || dimensions_assessed, sessions_total, round(v, 2) FROM scp JOIN fc USING (capture_id, protocol)
  UNION ALL SELECT capture_id, 'standard', standard, sections, NULL, NULL FROM st
  UNION ALL SELECT capture_id, 'remediation', issue_class, severity || '|' || observed || '|' || verification, position, recurrence FROM rp JOIN rem ON issue_class = cls
  UNION ALL SELECT capture_id, 'abstention', rule_id, reason || '|' || issue_class || '|' || coalesce(protocol, '') || '|' || what || '|' || resolved, abstentions, sessions FROM ac
  UNION ALL SELECT capture_id, 'provenance', rule_ids, NULL, fused_findings, deterministic_findings FROM prov
  UNION ALL SELECT capture_id, 'fact_rows', NULL, 'true', fused_findings, NULL FROM prov
  UNION ALL SELECT capture_id, 'abstention_rows', NULL, 'true', abstentions, NULL FROM prov""")
def assessment_document(spark, sf):
    """Written as canonical JSON, read back, and taken apart again; the hash of what was read equals
    the one that was written."""
    docs = made_documents(spark, sf)
    path = lineage.scratch(spark, "documents")
    catalog.write_documents(docs, path)
    back = catalog.read_documents(spark, path, docs.schema)
    same = back.withColumn("same", (catalog.content_hash(back.drop("content_sha256")) == F.col("content_sha256")).cast("string"))

    def row(section, name=None, part=None, n=None, value=None):
        null = F.lit(None)
        return F.struct(F.lit(section).alias("section"), (null if name is None else name).cast("string").alias("name"),
                        (null if part is None else part).cast("string").alias("part"), (null if n is None else n).cast("bigint").alias("n"),
                        (null if value is None else value).cast("double").alias("value"))

    def rows(section, field, name, parts, n=None, value=None):
        def one(r):
            texts = [F.array_join(r[p], ",") if p == "protocols" else F.coalesce(r[p], F.lit("")) for p in parts]
            return row(section, r[name], F.concat_ws("|", *texts), r[n] if n else None, F.round(r[value].cast("double"), 2) if value else None)
        return F.transform(field, one)

    cells = F.flatten(F.array(
        F.array(row("score", F.col("assessment_id"), F.col("overall_posture"), F.col("coverage.sessions_assessed"), F.round("score.value", 2)),
                row("provenance", F.col("provenance.rule_ids"), None, F.col("provenance.fused_findings"), F.col("provenance.deterministic_findings")),
                row("fact_rows", None, F.col("same"), F.col("fact_rows.rows")), row("abstention_rows", None, F.col("same"), F.col("abstention_rows.rows"))),
        rows("group", "issue_groups", "issue_class", ["fact_kind", "severity", "certainty", "protocols"], "recurrence", "finding_count"),
        rows("priority", "prioritised", "issue_class", ["fact_kind", "representative"], "rank", "priority_score"),
        rows("penalty", "components", "issue_class", ["fact_kind", "severity"], "recurrence", "penalty"),
        rows("protocol", "protocol_posture", "protocol", ["band", "issue_classes", "dimensions_assessed"], "sessions_total", "value"),
        rows("standard", "standards_summary", "standard", ["sections"]),
        rows("remediation", "remediation_summary", "issue_class", ["severity", "observed", "verification"], "position", "recurrence"),
        rows("abstention", "abstentions", "rule_id", ["reason", "issue_class", "protocol", "what_could_not_be_concluded", "resolved_by"], "abstentions", "sessions")))
    return same.select("capture_id", F.inline(cells))


def _cells(source: str, table: str, position: str, columns: dict[str, str]) -> str:
    """The cells of one report table; a missing or empty value is a dash."""
    return " UNION ALL ".join(f"""SELECT capture_id, '{table}' AS "table", CAST({position} AS INT) AS "row", '{title}' AS "column", coalesce(nullif(CAST({sql} AS VARCHAR), ''), '—') AS value FROM {source}"""
                              for title, sql in columns.items())


_NUM = "regexp_replace(regexp_replace(printf('%.2f', CAST({c} AS DOUBLE)), '0+$', ''), '\\.$', '')"


@query("report_tables", f"""{PARTS},
  s2 AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY standard) - 1 AS place FROM st),
  a2 AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY reason, issue_class, rule_id, protocol NULLS FIRST) - 1 AS place FROM ac),
  p2 AS (SELECT scp.capture_id, protocol, sessions_total, v, band, dimensions_assessed, dimensions_not_observable, abstentions, row_number() OVER (PARTITION BY scp.capture_id ORDER BY protocol) - 1 AS place
    FROM scp JOIN fc USING (capture_id, protocol) JOIN ab USING (capture_id, protocol)),
  r2 AS (SELECT rp.capture_id, observed, why, action, verification, recurrence, array_to_string(stds, ', ') AS standard, position - 1 AS place FROM rp JOIN rem ON issue_class = cls),
  pk AS (SELECT capture_id, unnest(['Abstentions', 'Contradictions recorded', 'Cross session findings', 'Deterministic findings', 'Duplicate sources merged', 'Fused findings', 'Rule ids']) AS item,
    unnest([CAST(abstentions AS VARCHAR), CAST(contradictions_recorded AS VARCHAR), CAST(cross_session_findings AS VARCHAR), CAST(deterministic_findings AS VARCHAR),
      CAST(duplicate_sources_merged AS VARCHAR), CAST(fused_findings AS VARCHAR), rule_ids]) AS shown, unnest(range(0, 7)) AS place FROM prov),
  ck AS (SELECT capture_id, unnest(['Assessed fraction', 'Sessions abstained', 'Sessions assessed', 'Sessions total']) AS item,
    unnest([{_NUM.format(c='assessed_fraction')}, CAST(sessions_abstained AS VARCHAR), CAST(sessions_assessed AS VARCHAR), CAST(sessions_total AS VARCHAR)]) AS shown, unnest(range(0, 4)) AS place FROM cov)
  {_cells('s2', 'standards', 'place', {'Standard': 'standard', 'Sections': 'sections'})}
  UNION ALL {_cells('a2', 'abstentions', 'place', {'Reason': label_sql('abstention_reason', 'reason'), 'Issue class': human_sql('issue_class'), 'Could not conclude': 'what',
                                                   'Would be resolved by': 'resolved', 'Protocol': 'protocol', 'Sessions': 'sessions'})}
  UNION ALL {_cells('p2', 'protocol_posture', 'place', {'Protocol': 'protocol', 'Sessions': 'sessions_total', 'Band': label_sql('posture', 'band'), 'Score': _NUM.format(c='v'),
                                                        'Dimensions assessed': "replace(replace(dimensions_assessed, '_', ' '), ',', ', ')",
                                                        'Not observable': "replace(dimensions_not_observable, '_', ' ')", 'Abstentions': 'abstentions'})}
  UNION ALL {_cells('r2', 'remediation', 'place', {'Observed': 'observed', 'Why it matters': 'why', 'Recommended action': 'action', 'Sessions': 'recurrence',
                                                   'Verification': 'verification', 'Standard': 'standard'})}
  UNION ALL {_cells('pk', 'provenance', 'place', {'Item': 'item', 'Value': 'shown'})}
  UNION ALL {_cells('ck', 'coverage', 'place', {'Item': 'item', 'Value': 'shown'})}""")
def report_tables(spark, sf):
    """The tables that SQL sets out; scope, score, states and risk come the same way and are tested apart."""
    cells = marts.report_tables(made_documents(spark, sf))
    return cells.filter(F.col("table").isin("standards", "abstentions", "protocol_posture", "remediation", "provenance", "coverage")
                        & ~((F.col("table") == "standards") & (F.col("column") == "Citations")))
