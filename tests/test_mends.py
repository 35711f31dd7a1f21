"""Nothing is cut: chains, files of one name, contents of one batch, and the AI switch."""

from pyspark.sql import functions as F

from queries import lifts
from wirepost.operators import crypto
from wirepost.plans import assessment
from wirepost.sources import catalog, ek

SF = "/root/testdata/sf0.001"


def test_a_weak_twelfth_certificate_is_judged(spark):
    rows = [(1, i, 1024 if i == 11 else 4096, 0, 1, f"s{i}", f"a{i}", "1.2.3") for i in range(12)]
    certs = spark.createDataFrame(rows, "tcp_stream_id long, idx int, key_bits int, not_before long, not_after long, ski string, aki string, sig_oid string")
    chain = crypto.chain_arrays(certs, ["tcp_stream_id"]).first()
    assert len(chain["certificates"]) == 12 and min(c["key_bits"] for c in chain["certificates"]) == 1024
    x509 = F.struct(*[(F.array(*[F.lit(f"{n}{i}") for i in range(12)]) if n == "serials" else F.array().cast("array<string>")).alias(n)
                      for n in crypto.vocab.X509_FIELD_NAMES])
    built = crypto.build_chain(spark.range(1).select(x509.alias("x509"))).first()
    assert len(built["certificates"]) == 12 and built["chain_truncated"]


def test_files_of_one_name_are_two_captures(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.json").write_text('{"layers": {"frame": "1"}}\n')
    got = ek.read_ek(spark, str(tmp_path)).select("capture_id").distinct().collect()
    assert len(got) == 2 and all(r.capture_id.startswith("x-") for r in got)


def test_content_hash_tells_contents_apart(spark):
    rows = [(1, None, "z"), (2, "null", "z"), (3, "x|b=y", "z"), (4, "x", "y|b=z")]
    df = spark.createDataFrame(rows, "run_id long, a string, b string")
    assert df.select(catalog.content_hash(df)).distinct().count() == 4
    nested = spark.sql("SELECT 1 AS run_id, named_struct('b', 1, 'a', array(2)) AS d")
    other = spark.sql("SELECT 2 AS run_id, named_struct('a', array(2), 'b', 1) AS d")
    assert nested.select(catalog.content_hash(nested)).first() == other.select(catalog.content_hash(other)).first()


def test_two_contents_for_one_new_id_conflict(spark):
    new = spark.createDataFrame([("n", "1"), ("n", "2"), ("m", "1"), ("m", "1"), ("old", "1"), ("old", "2")], "assessment_id string, content_sha256 string")
    stored = spark.createDataFrame([("old", "1")], new.schema)
    got = sorted((r.assessment_id, r.content_sha256, r.action) for r in catalog.upsert_assessments(new, stored).collect())
    assert got == [("m", "1", "insert"), ("m", "1", "insert"), ("n", "1", "conflict"), ("n", "2", "conflict"), ("old", "1", "replay"), ("old", "2", "conflict")]


def test_ai_does_not_move_the_score(spark):
    s = lifts.sessions(spark, SF, with_certificates=True)
    cols = ["capture_id", "value", "band", "total_penalty"]
    plain = sorted(map(tuple, assessment.assess(spark, s).select(*cols).collect()))
    assert plain == sorted(map(tuple, assessment.assess(spark, s, ai=True).select(*cols).collect()))
