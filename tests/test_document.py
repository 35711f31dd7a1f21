"""The nested record and the report tables, captures of any size, and occlusion against probes."""

import hashlib
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from queries import lifts
from wirepost.operators import anomaly, evaluation, marts
from wirepost.plans import assessment, document
from wirepost.sources import catalog, ek

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    return assessment.run(spark, lifts.sessions(spark, SF, with_certificates=True))


def hashes(docs):
    return {r["capture_id"]: r["content_sha256"] for r in docs.select("capture_id", "content_sha256").collect()}


def test_another_run_is_a_replay_and_another_fact_is_not(spark, made):
    first = document.documents(made, run_id="r1", generated_at="t1")
    again = document.documents(replace(made, facts=made.facts.repartition(5), groups=made.groups.repartition(3)), run_id="r2", generated_at="t2")
    stored = first.select("assessment_id", "content_sha256")
    actions = [r["action"] for r in catalog.upsert_assessments(again.select("assessment_id", "content_sha256"), stored).collect()]
    assert actions and set(actions) == {"replay"}
    one = made.facts.agg(F.min(F.struct("capture_id", "stream_key", "issue_class", "fact_kind"))).first()[0]
    at = (F.col("capture_id") == one[0]) & (F.col("stream_key") == one[1]) & (F.col("issue_class") == one[2]) & (F.col("fact_kind") == one[3])
    other = document.documents(replace(made, facts=made.facts.withColumn("conclusion", F.when(at, "another").otherwise(F.col("conclusion")))))
    old, new = hashes(first), hashes(other)
    assert {c for c in old if old[c] != new[c]} == {one[0]}


def test_written_and_read_back(spark, made, tmp_path):
    docs = document.documents(made, run_id="r1")
    catalog.write_documents(docs, str(tmp_path / "docs"))
    back = catalog.read_documents(spark, str(tmp_path / "docs"), docs.schema)
    assert hashes(back) == {r[0]: r[1] for r in back.select("capture_id", catalog.content_hash(back.drop("content_sha256"))).collect()} == hashes(docs)


def test_a_capture_without_findings_has_its_record_and_tables(spark, made):
    quiet = made.sessions.agg(F.min("capture_id")).first()[0]
    cut = {n: getattr(made, n).filter(F.col("capture_id") != quiet) for n in ("classified", "facts", "groups")}
    docs = document.documents(replace(made, **cut))
    row = docs.filter(F.col("capture_id") == quiet).first()
    assert row["overall_posture"] == "INSUFFICIENT_EVIDENCE" and row["issue_groups"] == [] and row["coverage"]["sessions_assessed"] == 0
    cells = marts.report_tables(docs).filter(F.col("capture_id") == quiet).collect()
    assert {c["table"] for c in cells} == {"scope", "score", "coverage", "evidence_states", "completeness", "protocol_posture", "risk", "provenance"}
    assert {c["value"] for c in cells if c["table"] == "provenance" and c["column"] == "Value"} == {"—"}


def test_facts_of_scope_and_states(spark, made):
    docs = document.documents(made)
    cells = marts.report_tables(docs).collect()
    for doc in docs.select("capture_id", "coverage").collect():
        table = lambda name: [c for c in cells if c["capture_id"] == doc["capture_id"] and c["table"] == name]
        value = {(c["table"], c["row"], c["column"]): c["value"] for n in ("scope", "evidence_states", "completeness", "coverage") for c in table(n)}
        shown = {(t, v): value[t, r, "Value"] for (t, r, column), v in value.items() if column == "Item"}
        want = doc["coverage"].asDict()
        assert sum(int(c["value"]) for c in table("scope") if c["column"] == "Value") == want["sessions_total"] == int(shown["coverage", "Sessions total"])
        assert int(shown["evidence_states", "State observed"]) == want["state_observed"]
        assert int(shown["completeness", "Complete"]) == want["complete"]


def test_captures_of_any_size(spark, tmp_path):
    """A name that looks compressed, a blank in a name, an empty file, and one beyond 2 GiB."""
    contents = {"a.gz": b"not compressed", "b c.pcap": b"x" * 3_000_000, "e.pcap": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    for whole in (0, 1000, ek.WHOLE_FILE):
        got = {r["filename"]: (r["size_bytes"], r["sha256"]) for r in ek.capture_catalog(spark, str(tmp_path), whole).collect()}
        assert got == want
    size = (2 << 30) + 5
    with open(tmp_path / "huge.pcap", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & ((1 << 20) - 1)))
    got = {r["filename"]: (r["size_bytes"], r["sha256"]) for r in ek.capture_catalog(spark, str(tmp_path)).collect()}
    assert got == {**want, "huge.pcap": (size, digest.hexdigest())}


@pytest.mark.parametrize("top", [None, 1, 3, 20])
def test_occlusion_equals_probes_scored_anew(spark, top):
    rnd = random.Random(7)
    rows = [[rnd.choice([0.0, 1.0, 5.0, rnd.gauss(0, 3)]) for _ in range(8)] for _ in range(12)]
    reference = [rnd.choice([0.0, 2.0, -4.0]) for _ in range(8)]
    fit = [(rnd.choice([0.0, 1.0]), rnd.choice([0.5, 2.0]), c == 2) for c in range(8)]

    def terms(row):
        return [(0.0 if v == m else 3.0) if constant else abs(v - m) / scale for v, (m, scale, constant) in zip(row, fit)]

    def score(row):
        t = sorted(terms(row), reverse=True)
        return sum(t) if top is None else sum(t[:top]) / len(t[:top])
    want = {}
    for i, row in enumerate(rows):
        drops = [(j, score(row) - score([*row[:j], reference[j], *row[j + 1:]])) for j in range(8) if row[j] != reference[j]]
        want[i] = {j: round(d, 6) for j, d in drops if d > 1e-9}
    long = spark.createDataFrame([("g", i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)], "g string, id int, column int, value double")
    stats = spark.createDataFrame([("g", j, *f) for j, f in enumerate(fit)], "g string, column int, med double, scale double, constant boolean")
    ref = spark.createDataFrame([("g", j, v) for j, v in enumerate(reference)], "g string, column int, reference double")
    got = {i: {} for i in want}
    for r in anomaly.occlusion_robust(long, stats, ref, ["g"], "id", k=8, top=top).collect():
        got[r["id"]][r["column"]] = round(r["delta"], 6)
    assert got == want


def test_layout_and_subsets_of_groups():
    subsets = evaluation.group_subsets()
    assert set(subsets["all"]) == set(anomaly.FEATURES) == set(subsets["only_tls"]) | set(subsets["without_tls"])
    assert not set(subsets["only_tls"]) & set(subsets["without_tls"]) and len(subsets) == 12
    with pytest.raises(ValueError):
        evaluation.group_ablation(None, {"x": ["no such feature"]})
    text = "\n".join(anomaly.COLUMNS)
    assert len(anomaly.COLUMNS) == len(set(anomaly.COLUMNS)) and text.startswith("app_state=")


def test_digest_adds_small_numbers_and_is_what_it_was(spark):
    df = spark.range(300).selectExpr("id % 2 AS k", "id", "array(CAST(id AS STRING), null) AS a", "array(named_struct('b', id, 'a', null)) AS s")
    h = F.sha2(catalog.canonical_json(df, ("k",)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("digest"))
    got = catalog.table_digest(df, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert re.findall(r"cast\((\w+)#\d+L as decimal", got._jdf.queryExecution().optimizedPlan().toString()) == [f"_p{i}" for i in range(8)]
