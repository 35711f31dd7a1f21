"""Removal of repeated passages by level-wise doubling.

Every word covered by a window (`window` consecutive words) whose words also start anywhere else is
removed.  Lengths double: a quarter of the window, half of it, the window.  Only what repeats at one
length is extended to the next, and the search ends when no candidates survive.

* First length k: each window is looked up by one of its k-grams, that with the least hash (the
  leftmost of equals).  Equal windows choose the same k-gram at the same offset, so only these
  anchors are counted, about two in window - k + 2 positions.  The windows of an anchor are a run.
* Runs with equal text around an anchor are one class; the windows of a class with two members are
  all repeated and need no further look.
* Second length 2k: each side of the other classes is extended from its anchor; a side goes on only
  if its extension occurs in another class of that anchor.
* Full length: the windows of the surviving sides, one representative per class, are counted.

Windows are judged on the input.  Defined results: null counts as empty; texts with fewer words than
a window lose nothing; rows that repeat an id or text are documents of their own (each repeats the
other); a null id is judged like any other; an empty table gives an empty result; other columns are
not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch, words

WINDOW = 35
#: windows sent on together
SENT = 1 << 17


def first_length(window: int) -> int:
    return max(1, -(-window // 4))


def argmin_left(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every run of `width` values."""
    best, span = np.arange(len(values)), 1

    def better(a, b):
        return np.where(values[a] <= values[b], a, b)

    while span * 2 <= width:
        best = better(best[:len(best) - span], best[span:])
        span *= 2
    rest = width - span
    return better(best[:len(best) - rest], best[rest:]) if rest else best


def spans(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the words of each span, whatever their lengths."""
    base = 0xA24BAED4963EE407
    n = len(hashes)
    up, down = words.powers(base, n), words.powers(pow(base, -1, 1 << 64), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(hashes) * up, dtype=np.uint64)])
    return words.mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))


def _runs(window: int):
    """(row, start, count, offset, anchor, right, left, span) of the runs of each text: windows
    start .. start+count-1 share the anchor at start+offset."""
    k = first_length(window)

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, hashes, bounds in words.hashed(batch.column(1)):
                n = len(hashes)
                if n < window:
                    continue
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                grams, longer = words.windows(hashes, k), words.windows(hashes, 2 * k)
                at = argmin_left(grams, window - k + 1)
                valid = np.flatnonzero(owner[:n - window + 1] == owner[window - 1:])
                if not len(valid):
                    continue
                at = at[valid]
                new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(owner[valid]) != 0)])
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(valid)))
                start, anchor = valid[begin], at[begin]
                offset = anchor - start
                # a window goes right where the doubled gram from the anchor on lies inside it, else left
                right = np.where(offset - count + 1 <= window - 2 * k, longer[np.minimum(anchor, len(longer) - 1)].view(np.int64) >> 32, 0)
                left = np.where(offset > window - 2 * k, longer[np.clip(anchor - k, 0, len(longer) - 1)].view(np.int64) >> 32, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[first + owner[start]]), pa.array((start - bounds[owner[start]]).astype(np.int32)), pa.array(count.astype(np.int16)),
                     pa.array(offset.astype(np.int16)), pa.array(grams[anchor].view(np.int64)), pa.array(right.astype(np.int32)), pa.array(left.astype(np.int32)),
                     pa.array(spans(hashes, start, count + window - 1).view(np.int64))],
                    ["row", "start", "count", "offset", "anchor", "right", "left", "span"])
    return run


def _windows(window: int):
    """(anchor, offset, hash, row, start, n) of every window of the surviving sides of each text."""
    def run(batches):
        for batch in batches:
            rows, sides, held, size = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], 0
            for first, hashes, bounds in words.hashed(batch.column(1)):
                for i in range(len(bounds) - 1):
                    own = sides[first + i]
                    every = words.windows(hashes[bounds[i]:bounds[i + 1]], window).view(np.int64)
                    for s in own:
                        m, at = s["count"], s["start"]
                        held.append((np.full(m, s["anchor"]), s["offset"] - np.arange(m), every[at:at + m], np.full(m, rows[first + i]),
                                     at + np.arange(m), np.full(m, s["n"])))
                        size += m
                    if size > SENT:
                        yield _columns(held)
                        held, size = [], 0
            if held:
                yield _columns(held)
    return run


def _columns(held) -> pa.RecordBatch:
    kinds = (np.int64, np.int32, np.int64, np.int64, np.int32, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*held), kinds)],
                                      ["anchor", "offset", "hash", "row", "start", "n"])


def _strip(window: int):
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) from (id, text, runs of windows)."""
    def run(batches):
        for batch in batches:
            total, gone, digests, kept = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                own = text.as_py().split()
                n = len(own)
                if runs:
                    steps = np.zeros(n + 1, np.int64)
                    at = np.array([r["start"] for r in runs])
                    np.add.at(steps, at, 1)
                    np.add.at(steps, np.minimum(at + [r["count"] + window - 1 for r in runs], n), -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(steps[:n]) == 0)]
                body = b" ".join(own)
                total.append(n)
                gone.append(n - len(own))
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def repeated_runs(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, count): windows start .. start+count-1 of the text occur elsewhere.  `texts` has
    the columns row (unique long) and text (binary)."""
    k = first_length(window)
    runs = scratch.keep(texts.mapInArrow(_runs(window), "row bigint, start int, count short, offset short, anchor bigint, right int, left int, span bigint"), "runs")
    twice = runs.groupBy("anchor").count().filter("count > 1").select("anchor")
    live = scratch.keep(scratch.narrow(runs, "anchor", twice).join(twice, "anchor", "left_semi"), "level1")

    kind = ["anchor", "offset", "count", "span"]
    classes = scratch.keep(live.groupBy(*kind, "right", "left").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min_by("start", "row").alias("start")), "classes")
    whole = live.join(classes.filter("n > 1").select(*kind), kind, "left_semi").select("row", "start", "count")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("anchor")

    # windows with offset <= window - 2k extend to the right of their anchor, the others to the left
    turn = F.greatest(F.lit(0), F.least(F.col("count").cast("int"), F.col("offset") - (window - 2 * k)))
    sides = classes.join(several, "anchor", "left_semi").withColumn("turn", turn).select(
        "anchor", "n", "row", F.explode(F.array(
            F.struct(F.lit(True).alias("to_left"), F.col("left").alias("double"), F.col("start").alias("start"), F.col("offset").cast("int").alias("offset"), F.col("turn").alias("count")),
            F.struct(F.lit(False).alias("to_left"), F.col("right").alias("double"), (F.col("start") + F.col("turn")).alias("start"),
                     (F.col("offset") - F.col("turn")).alias("offset"), (F.col("count") - F.col("turn")).alias("count")))).alias("s")) \
        .select("anchor", "n", "row", "s.*").filter("count > 0")
    sides = scratch.keep(sides, "sides")
    doubled = sides.groupBy("anchor", "to_left", "double").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    going = scratch.keep(sides.join(doubled.select("anchor", "to_left", "double"), ["anchor", "to_left", "double"], "left_semi"), "level2")

    asked = going.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "offset", "count", "n")).alias("sides"))
    found = scratch.narrow(texts, "row", asked.select("row")).join(asked, "row").select("row", "text", "sides") \
        .mapInArrow(_windows(window), "anchor bigint, offset int, hash bigint, row bigint, start int, n bigint")
    found = scratch.keep(found, "level3")
    same = ["anchor", "offset", "hash"]
    again = found.groupBy(*same).agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1 and least = 1").select(*same)
    single = found.filter("n = 1").join(again, same, "left_semi").select("row", "start", F.lit(1).cast("short").alias("count"))
    return whole.unionByName(single)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per row of `docs`; kept is the
    remaining words joined by one space."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = base.agg(F.count(F.lit(1)), F.count("id")).first()
    unique = ids[0] == ids[1] and base.groupBy("id").count().filter("count > 1").isEmpty()
    row = F.col("id") if unique else F.xxhash64("id", "text")
    rows = base.select(row.cast("bigint").alias("row"), "id", F.col("text").cast("binary").alias("text"))
    runs = repeated_runs(rows.select("row", "text"), window)
    runs = scratch.keep(runs.groupBy("row").agg(F.collect_set(F.struct("start", "count")).alias("runs")), "repeated")
    touched, clean = scratch.split(rows, "row", runs.select("row"))
    cut = touched.join(runs, "row", "left").select("id", "text", "runs") \
        .unionByName(clean.select("id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")))
    out = cut.mapInArrow(_strip(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
