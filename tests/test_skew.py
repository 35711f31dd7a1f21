"""The chunked and binned operators against brute force, with one key holding most rows."""

import random
import statistics

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.operators import skew


def hot_rows(n=4000, seed=3):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.8 else f"k{rnd.randrange(5)}", i, rnd.randrange(50), round(rnd.gauss(0, 3), 2))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at long, v long, x double") \
        .withColumn("block", F.floor(F.col("at") / 100)).repartition(7)


def test_ordinals_and_running_total(spark):
    rows = hot_rows()
    df = frame(spark, rows)
    out = skew.running_total(skew.ordinals(df, ["key"], "block", ["at"], "n"), ["key"], "block", ["at"], F.col("v"), "total")
    seen, total = {}, {}
    want = {}
    for k, at, v, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        total[k] = total.get(k, 0) + v
        want[at] = (seen[k], total[k])
    assert {r["at"]: (r["n"], r["total"]) for r in out.collect()} == want


def test_running_max_before(spark):
    rows = hot_rows(800)
    out = skew.running_max(frame(spark, rows), ["key"], "block", ["at"], F.col("v"), "m", before=True)
    top, want = {}, {}
    for k, at, v, _ in rows:
        want[at] = top.get(k)
        top[k] = max(v, top.get(k, v))
    assert {r["at"]: r["m"] for r in out.collect()} == want


def test_chunked_window_equals_whole_window(spark):
    df = skew.ordinals(frame(spark, hot_rows()), ["key"], "block", ["at"], "n")
    cut = skew.chunked(df, ["key"], "n", lookback=50, chunk=128)
    near = W.partitionBy("key", "_chunk").orderBy("n").rowsBetween(-50, -1)
    whole = W.partitionBy("key").orderBy("at").rowsBetween(-50, -1)
    got = {r["at"]: r["s"] for r in skew.own_rows(cut.withColumn("s", F.sum("v").over(near))).collect()}
    want = {r["at"]: r["s"] for r in df.withColumn("s", F.sum("v").over(whole)).collect()}
    assert got == want


def test_exact_median(spark):
    rows = hot_rows(3001)
    got = {r["key"]: round(r["median"], 9) for r in skew.median(frame(spark, rows), ["key"], "x").collect()}
    by = {}
    for k, _, _, x in rows:
        by.setdefault(k, []).append(x)
    assert got == {k: round(statistics.median(v), 9) for k, v in by.items()}


def test_chunk_shorter_than_the_look_back(spark):
    df = skew.ordinals(frame(spark, hot_rows(600)), ["key"], "block", ["at"], "n")
    cut = skew.chunked(df, ["key"], "n", lookback=20, chunk=8)
    near = W.partitionBy("key", "_chunk").orderBy("n").rowsBetween(-20, -1)
    whole = W.partitionBy("key").orderBy("at").rowsBetween(-20, -1)
    got = {r["at"]: r["s"] for r in skew.own_rows(cut.withColumn("s", F.sum("v").over(near))).collect()}
    assert got == {r["at"]: r["s"] for r in df.withColumn("s", F.sum("v").over(whole)).collect()}


def test_median_with_heavy_tail_and_infinity(spark):
    rnd = random.Random(8)
    values = {"tail": [rnd.paretovariate(0.3) for _ in range(801)], "inf": [float("inf")] * 3 + [-float("inf")] + [rnd.random() for _ in range(60)],
              "offset": [1e9 + rnd.random() for _ in range(301)], "all_inf": [float("inf")] * 5, "negative": [-rnd.paretovariate(0.5) for _ in range(101)]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs], "key string, x double").repartition(3)
    got = {r["key"]: r["median"] for r in skew.median(df, ["key"], "x").collect()}
    assert got == {k: statistics.median(xs) for k, xs in values.items()}
