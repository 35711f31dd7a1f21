"""A batch that fails or repeats, documents whose keys come in another order, digests of tables."""

import pytest
from pyspark.sql import functions as F

from wirepost.sources import catalog
from wirepost.streaming import ingest

SCHEMA = "assessment_id string, content_sha256 string"


class Failing(ingest.AssessmentStore):
    """Fails once, after both tables are written and before the manifest names them."""
    failed = False

    def commit(self, spark, epoch, attempt):
        if not self.failed:
            self.failed = True
            raise OSError("lost")
        super().commit(spark, epoch, attempt)


def contents(spark, store):
    schema = spark.createDataFrame([], SCHEMA).schema
    return [sorted(map(tuple, store.read(spark, part, schema).collect())) for part in ("stored", "conflicts")]


def test_a_failed_batch_run_again_counts_once(spark, tmp_path):
    batches = [spark.createDataFrame(rows, SCHEMA) for rows in (
        [("a", "1"), ("b", "1"), ("b", "1"), ("c", "1"), ("c", "2")], [("a", "1"), ("b", "9"), ("d", "1")])]
    plain = ingest.AssessmentStore(str(tmp_path / "plain"))
    for epoch, batch in enumerate(batches):
        plain.upsert(batch, epoch)
    want = contents(spark, plain)
    assert want == [[("a", "1"), ("b", "1"), ("d", "1")], [("b", "9"), ("c", "1"), ("c", "2")]]
    store = Failing(str(tmp_path / "failing"))
    for epoch, batch in enumerate(batches):
        store.failed = False
        before = contents(spark, store)
        with pytest.raises(OSError):
            store.upsert(batch, epoch)
        assert contents(spark, store) == before
        store.upsert(batch, epoch)
        store.upsert(batch, epoch)
    assert contents(spark, store) == want


def test_two_attempts_in_the_manifest_count_once(spark, tmp_path):
    store = ingest.AssessmentStore(str(tmp_path))
    rows = spark.createDataFrame([("a", "1")], SCHEMA)
    for attempt in ("b0-x", "b0-y"):
        rows.write.parquet(f"{tmp_path}/stored/attempt={attempt}")
        rows.limit(0).write.parquet(f"{tmp_path}/conflicts/attempt={attempt}")
        store.commit(spark, 0, attempt)
    assert contents(spark, store) == [[("a", "1")], []]


def test_keys_in_another_order_are_no_conflict(spark):
    one = spark.sql("SELECT 'x' AS assessment_id, 'r1' AS run_id, map('b', 2, 'a', 1) AS m, array(named_struct('q', 1, 'p', named_struct('z', 1, 'y', CAST(NULL AS INT)))) AS l")
    two = spark.sql("SELECT array(named_struct('p', named_struct('y', CAST(NULL AS INT), 'z', 1), 'q', 1)) AS l, map('a', 1, 'b', 2) AS m, 'r2' AS run_id, 'x' AS assessment_id")
    three = two.withColumn("m", F.expr("map('a', 1, 'b', 3)"))
    h = [d.select("assessment_id", catalog.content_hash(d).alias("content_sha256")) for d in (one, two, three)]
    assert [catalog.upsert_assessments(new, h[0]).first()["action"] for new in h] == ["replay", "replay", "conflict"]


def test_digest_tells_tables_apart_and_ignores_order(spark):
    rows = [("k", i, f"t{i}") for i in range(50)] + [("e", 1, None)]
    df = spark.createDataFrame(rows, "key string, n int, t string")
    digest = lambda d: {r["key"]: (r["rows"], r["digest"]) for r in catalog.table_digest(d, ["key"]).collect()}
    assert digest(df) == digest(df.repartition(7).select("t", "key", "n"))
    again = digest(df.unionByName(df.filter("n = 3")))
    assert again["k"] != digest(df)["k"] and again["e"] == digest(df)["e"]
