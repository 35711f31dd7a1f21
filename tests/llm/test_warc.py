import base64
import hashlib

import pytest

from llm import cases
from wirepost.llm import scratch, warc

SCHEMA = "page_id long, url string, html string, sha256 string, header string"
PAGES = [(1, "http://a/", "<p>x", "s", "h"), (5, "http://b/?q=ü", "<p>x", None, None), (3, None, "<p>x", "s", "h"), (4, "no scheme", None, "s", "h"),
         (6, "http://c/", "", "s", "h"), (7, "http://c/\nInjected: 1", "ä\r\n\r\nb", "s", "h"), (8, "u", "y" * 300_000, "s", "h"), (9, "u", "y" * 300_000, "s", "h"),
         (None, "u", "only here", "s", "h"), (None, "u", "<p>x", "s", "h"), (2, "u", "twice", "s", "h"), (2, "u", "twice", "s", "h")]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


def expected(smallest=0):
    out = []
    for i, _, html, *_ in PAGES:
        body = (html or "").encode()
        ids = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        keeper = max(ids) if ids else None
        kind = "response" if i == keeper or len(body) < smallest else "revisit"
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, keeper if kind == "revisit" else None))
    return cases.ordered(out)


@pytest.mark.parametrize("smallest", [0, 5])
def test_round_trip(spark, tmp_path, smallest):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    warc.write_archive(pages, str(tmp_path / "a"), smallest=smallest)
    records = warc.read_archive(spark, str(tmp_path / "a"))
    assert cases.ordered(warc.facts(records).collect()) == expected(smallest)
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == stored.select("sha256").distinct().count() == len({p[2] or "" for p in PAGES})
    one = {warc.parse(bytes(r.record))[0]["warc-target-uri"] for r in records.collect()}
    assert "http://b/?q=ü" in one and "http://c/ Injected: 1" in one


def test_damage_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    warc.write_archive(pages, str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads"))
    headers = spark.read.parquet(str(tmp_path / "a/headers"))
    headers.write.parquet(str(tmp_path / "b/headers"))
    payloads.limit(3).write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="payload is missing"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    headers.write.parquet(str(tmp_path / "c/headers"))
    other = bytes(payloads.first().frame)
    payloads.rdd.map(lambda r: (r.sha256, bytearray(other))).toDF("sha256 binary, frame binary").write.parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "c")).collect()


def test_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.facts(warc.read_archive(spark, str(tmp_path / "a"))).count() == 0
