"""The five stages on awkward rows, each against plain Python on its own input."""

import pytest

import corpus_pipeline
from llm import cases
from wirepost.llm import exact_dedup, mixing, ngram_join, scratch

HELPERS = ["row_hash", "kept_hash", "mix_id", "mix_all", "mix_rows", "mix_place", "mix_taken", "mix_copy", "__copies", "__all", "__keep", "__id", "id", "row", "text_sha256"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = cases.documents() + [(100 + i, cases.prose(900 + i, 80), "en", "abc"[i % 3], 1, 1, "r", "x") for i in range(40)]
    cases.frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 4 != 3, 0) for i in range(100, 140)], "doc_id long, quality boolean, toxic int") \
        .selectExpr("doc_id", "cast(quality as int) quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, folder):
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        after = stage(spark, docs, folder)
        if name != "tokens":
            assert after.columns == columns
            after = scratch.keep(after, name)
        got = rows_of(after)
        if name == "quality":
            assert got and set(got) <= set(before)
        elif name == "exact_dedup":
            want = {sha for *_, sha in cases.exact_groups(before)}
            assert len(got) == len(want) == len({sha for *_, sha in cases.exact_groups(got)})
        elif name == "near_dedup":
            want = {i for i, _, c in cases.near_groups(before) if i is None or i == c}
            assert {r[0] for r in got} == want and set(got) <= set(before)
        elif name == "mix":
            assert set(got) <= set(before) and all(got.count(r) <= 2 * before.count(r) for r in set(got))
        else:
            assert sorted(r["doc_id"] for r in after.collect() if r["doc_id"] is not None) == sorted(r[0] for r in before if r[0] is not None)
            assert sorted(r["decoded_sha256"] for r in after.collect()) == sorted(cases.sha(r[1] or "") for r in before)
        docs = after


def repeated():
    a, b, c, d = (cases.prose(i, 90) for i in range(4))
    return [(1, a), (1, b), (2, b), (3, a + " end"), (5, c), (5, d + " end"), (4, c + " end"), (6, d), (1, a), (7, None), (7, "")]


def test_different_texts_of_one_id_are_not_lost(spark):
    docs = spark.createDataFrame(repeated(), "doc_id long, text string")
    exact = sorted((r.doc_id, r.text or "") for r in exact_dedup.drop_copies(docs).collect())
    groups = {}
    for i, t in repeated():
        groups[t or ""] = min(groups.get(t or "", i), i)
    assert exact == sorted((i, t) for t, i in groups.items())
    a, b, c, d = (cases.prose(i, 90) for i in range(4))
    near = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_first(docs).collect())
    assert [x for x in near if x[0] != 7] == sorted([(1, a), (1, b), (4, c + " end"), (5, d + " end")])


def test_clashing_names(spark):
    rows = [(i, cases.prose(i % 7, 60), "s%d" % (i % 3), *(["x"] * len(HELPERS))) for i in range(30)] + [(3, cases.prose(99, 50), "s0", *(["x"] * len(HELPERS)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{h}` string" for h in HELPERS))
    for out in (mixing.mix(docs), exact_dedup.drop_copies(docs), ngram_join.keep_first(docs)):
        assert out.columns == docs.columns and out.count() > 0
    assert exact_dedup.drop_copies(docs).count() == 8 == ngram_join.keep_first(docs).count()


def test_empty(spark):
    docs = cases.frame(spark, [])
    for stage in (exact_dedup.drop_copies, ngram_join.keep_first, mixing.mix):
        assert stage(docs).columns == docs.columns and stage(docs).count() == 0
