"""Quality selection by importance resampling.

Two generative models of hashed n-grams, one of the target (documents labelled good) and one of the
raw corpus (every document), give each document the log ratio of its likelihoods: its importance
weight.  Weights are perturbed by Gumbel noise, and the documents with the k largest keys are a
sample without replacement in proportion to the weights.

The n-grams of a document: words, word pairs, word endings with the one before (the last two bytes),
and which of the three words before a word equal it.  The raw model counts every document; the
target model is fitted on at most `SAMPLE` labelled rows, those with the smallest hashed ids.  By
default k is the number of documents whose key reaches the `LOST` quantile among all rows labelled
good, so that about this share of good documents is lost; `k` can be given.  Rows of the sample are
weighed by a model of the sample's other half, labelled rows outside it by the whole model, so that
the quantile is that of documents the model has not seen.

Defined results: null and empty texts have no n-grams and weight 0; labels that contradict each
other for one id, or are null, are not used; without target rows every weight is 0 and all are
selected; equal keys are selected together; rows that repeat an id are judged each; a null id is
judged like any other; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch, words

SAMPLE = 20_000
LOST = 0.005
#: buckets of words, word pairs, endings and repeats
SPACES = (1 << 12, 1 << 12, 1 << 10, 8)
BUCKETS = sum(SPACES)
#: n-grams of each bucket that are taken to be as expected, so that rare ones do not speak by chance
PRIOR = 10.0
#: keys are multiples of 1 / KEY
KEY = 1 << 16


def _grams(column: pa.Array):
    """(buckets of all n-grams of a few texts, their text, first row, texts)."""
    for first, hashes, ends, bounds in words.hashed_ends(column):
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        same = owner[1:] == owner[:-1]
        out = [(hashes % np.uint64(SPACES[0])).astype(np.int64)]
        who = [owner]
        if len(hashes) > 1:
            out.append(SPACES[0] + (words.grams(hashes, 2)[same] % np.uint64(SPACES[1])).astype(np.int64))
            who.append(owner[1:][same])
            pair = words.mix((ends[:-1] << 16 | ends[1:]).astype(np.uint64))[same] % np.uint64(SPACES[2])
            out.append(SPACES[0] + SPACES[1] + pair.astype(np.int64))
            who.append(owner[1:][same])
        repeats = np.zeros(len(hashes), np.int64)
        for back in (1, 2, 3):
            if len(hashes) > back:
                repeats[back:] |= ((hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])).astype(np.int64) << (back - 1)
        out.append(sum(SPACES[:3]) + repeats)
        who.append(owner)
        yield np.concatenate(out), np.concatenate(who), first, n


def _count(batches):
    """Counts of the task's n-grams: (bucket, raw, even, odd), the last two of the target's folds."""
    raw, even, odd = (np.zeros(BUCKETS, np.int64) for _ in range(3))
    for batch in batches:
        fold = batch.column(1).to_numpy()
        for grams, owner, first, _ in _grams(batch.column(0)):
            own = fold[first + owner]
            raw += np.bincount(grams, minlength=BUCKETS)
            even += np.bincount(grams[own == 0], minlength=BUCKETS)
            odd += np.bincount(grams[own == 1], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (used, raw[used], even[used], odd[used])], ["bucket", "raw", "even", "odd"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket log(p_target / p_raw), each space of n-grams a distribution of its own."""
    out, at = np.zeros(BUCKETS), 0
    for size in SPACES:
        r, t = raw[at:at + size], target[at:at + size]
        if t.sum():
            out[at:at + size] = np.log((t + PRIOR) / (t.sum() * r / r.sum() + PRIOR))
        at += size
    return out


def _weigh(ratios):
    """A text outside the target is weighed by the whole model, one inside by the other fold's."""
    def run(batches):
        tables = ratios.value
        for batch in batches:
            weights, fold = np.zeros(batch.num_rows), batch.column(3).to_numpy()
            for grams, owner, first, n in _grams(batch.column(2)):
                weights[first:first + n] = np.bincount(owner, tables[fold[first + owner], grams], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights)], ["id", "draw", "weight"])
    return run


def target_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int | None = SAMPLE) -> DataFrame:
    """Ids whose every label is 1: those with the smallest hashes, at most `sample`, or all of them."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null") \
        .groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if(F.col("label").isNull()).alias("none")) \
        .filter("low = 1 and high = 1 and none = 0")
    return (good if sample is None else _least(good, sample)).select("id")


def _least(ids: DataFrame, sample: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("id"), "id").limit(sample)


def rank_key(keyed: DataFrame, k: int) -> int:
    """The k-th largest value of the non-negative column `fixed`, exactly, by its 16-bit digits."""
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("fixed", shift).bitwiseAND(F.lit(0xFFFF))
        own = keyed.filter(F.shiftright("fixed", shift + 16) == prefix) if shift < 48 else keyed
        for d, n in own.groupBy(digit.alias("digit")).count().orderBy(F.desc("digit")).toLocalIterator():
            if n >= rest:
                prefix = prefix << 16 | d
                break
            rest -= n
    return prefix


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None,
               lost: float = LOST, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, log_weight, key, kept), one row per row of `docs`."""
    spark = docs.sparkSession
    labelled = scratch.keep(target_ids(labels, sample=None), "labelled")
    ids = scratch.keep(_least(labelled, sample), "target")
    folds = F.broadcast(ids.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(folds, "id", "left").withColumn("fold", F.coalesce("fold", F.lit(2)))
    counted = base.select(F.col("text").cast("binary").alias("text"), "fold") \
        .mapInArrow(_count, "bucket bigint, raw bigint, even bigint, odd bigint").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "even", "odd")])
    table = counted.toArrow()
    raw, even, odd = (np.zeros(BUCKETS) for _ in range(3))
    for name, counts in (("raw", raw), ("even", even), ("odd", odd)):
        counts[table["bucket"].to_numpy()] = table[name].to_numpy()
    ratios = spark.sparkContext.broadcast(np.stack([log_ratio(raw, odd), log_ratio(raw, even), log_ratio(raw, even + odd)]))
    scored = base.select("id", F.xxhash64("id", "text").alias("draw"), F.col("text").cast("binary").alias("text"), "fold") \
        .mapInArrow(_weigh(ratios), "id bigint, draw bigint, weight double")
    uniform = (F.shiftright(F.col("draw"), 12).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    fixed = F.round((F.col("weight") - F.log(-F.log(uniform))) * KEY).cast("bigint") + F.lit(1 << 61)
    keyed = scratch.keep(scored.withColumn("fixed", fixed), "keys")
    if k is None:
        good = scratch.keep(keyed.join(labelled, "id", "left_semi").select("fixed"), "good")
        n = good.count()
        floor = rank_key(good, n - int(math.floor(n * lost))) if n else 0
    else:
        floor = rank_key(keyed, k) if k > 0 else 1 << 62
    return keyed.select(F.col("id").alias("doc_id"), F.col("weight").alias("log_weight"),
                        ((F.col("fixed") - F.lit(1 << 61)) / KEY).alias("key"), (F.col("fixed") >= floor).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are selected, with all their columns.  An id stays if any of its rows
    is selected."""
    kept = importance(docs, labels, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]), "left_semi")
