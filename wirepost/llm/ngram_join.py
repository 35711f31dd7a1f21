"""Exact Jaccard self-join on word shingles by vertical partitioning.

All shingles stand in one global order, rare ones first: hash order, with the frequent shingles
moved to the end by their counts.  Two sets that reach the threshold share a shingle in their
prefixes, so the order's early part alone yields candidates.  The order is then cut into fragments;
each fragment counts the overlap of a candidate pair on its own, and the counts are summed per pair.

Pairs are not spread out within groups.  Equal sets are one class.  In every prefix shingle's list
one hub (the set with the least before that shingle, so the one closest to what the others share)
stands for the rest; each set is compared with two of its hubs, and the verified links give first
components.  Only pairs that are still in different components can change the result.  Of these, all
that share a prefix shingle are compared in a second round, unless the overlaps of both with a
common hub, or the number of prefix shingles they share, show that they cannot reach the threshold.

Defined results: null and empty texts, and texts without words, have no shingles and are alone; with
fewer than five words the whole sequence is one shingle; rows that repeat a text are one class; rows
that repeat an id get one row each and the smallest component of their texts; a null id gets a row with component null and
links nobody; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepost.llm import scratch, words
from wirepost.llm.components import components

WORDS = 5
#: similarity threshold in percent
LEAST = 80
#: occurrences from which a shingle is ranked by its count, and how many such shingles at most are
#: sent to every task (16 MB); any order gives the same result, this one gives short lists
FREQUENT, RANKED = 3, 1 << 20
#: parts that a frequent shingle's list is spread over
SALTS = 64
#: texts of a hub from which on they are measured against it
POPULAR = 64
#: places in a set from here on count as this one
FAR = 32767
FRAGMENTS = 4
#: shingles counted together before a task reports those that repeat
COUNTED = 1 << 21
#: shingles of cut sets sent on together
CUT = 1 << 18


def _sets(column: pa.Array, k: int):
    """Distinct shingle hashes (ascending) of each text, in row order."""
    for _, hashes, bounds in words.hashed(column, lower=True):
        every = words.grams(hashes, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(every[a:b - k + 1])
            elif b > a:
                yield words.grams(hashes[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def _survey(k: int):
    """One row per text (kind 0: id, size, digest) and per shingle that repeats within the task
    (kind 1: shingle, count).  Counts lead to an order only, so a rare miss costs time, not results."""
    def run(batches):
        held: list[np.ndarray] = []
        size, top = 0, (np.empty(0, np.uint64), np.empty(0, np.int64))

        def fold():
            nonlocal held, size, top
            found, counts = np.unique(np.concatenate(held), return_counts=True) if held else top
            keys, back = np.unique(np.concatenate([top[0], found]), return_inverse=True)
            total = np.bincount(back, np.concatenate([top[1], counts]), len(keys)).astype(np.int64)
            if len(keys) > RANKED:  # a mergeable heavy-hitter summary: drop the least, lower the rest by it
                cut = np.partition(total, len(total) - RANKED)[len(total) - RANKED]
                total = total - (cut - 1 if cut > 1 else 0)
            live = total > 1
            top, held, size = (keys[live], total[live]), [], 0

        for batch in batches:
            n, digests = [], []
            for tokens in _sets(batch.column(1), k):
                n.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                held.append(tokens)
                size += len(tokens)
                if size > COUNTED:
                    fold()
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary())],
                                             ["kind", "id", "n", "digest"])
        fold()
        if len(top[0]):
            m = len(top[0])
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(top[0].view(np.int64)), pa.array(top[1]), pa.nulls(m, pa.binary())],
                                             ["kind", "id", "n", "digest"])
    return run


def prefix_size(n: int, least: int) -> int:
    return n - -(-least * n // 100) + 1


class Order:
    """The global order; `frequent` are shingles by ascending count, then hash."""

    def __init__(self, frequent: np.ndarray):
        self.sorted = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable")

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """`tokens` (ascending) in global order, and how many of them are not frequent."""
        if not len(self.sorted) or not len(tokens):
            return tokens, len(tokens)
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        hit = self.sorted[at] == tokens
        rare = tokens[~hit]
        return np.concatenate([rare, tokens[hit][np.argsort(self.rank[at[hit]], kind="stable")]]), len(rare)


def _prefixes(k: int, least: int, frequent):
    """(token, salt, id, at): prefix shingles of each text and their places (at most 2**15 - 1) in
    its order.  Frequent shingles are known to repeat; their salt, 1 or more, spreads them.  One row
    per text with salt -1 tells in `at` how many of its prefix shingles are not frequent."""
    def run(batches):
        order = Order(frequent.value)
        for batch in batches:
            tokens, salts, ids, at = [], [], [], []
            for i, own in zip(batch.column(0).to_pylist(), _sets(batch.column(1), k)):
                if i is None or not len(own):
                    continue
                ranked, rare = order(own)
                m = prefix_size(len(own), least)
                tokens.append(np.append(ranked[:m], np.uint64(i & 0xFFFFFFFFFFFFFFFF)))
                salts.append(np.append(np.where(np.arange(m) < rare, 0, 1 + i % SALTS), -1).astype(np.int16))
                ids.append(np.full(m + 1, i, np.int64))
                at.append(np.minimum(np.append(np.arange(m), min(rare, m)), FAR).astype(np.int16))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (salts, ids, at))],
                    ["token", "salt", "id", "at"])
    return run


def _fragments(k: int, fragments: int, low: int, high: int):
    """(id, other, fragment, tokens): fragments low .. high-1 of a set, once for itself (other null)
    if it is the left of a pair, and once for each left side that it is to be compared with."""
    width = 64 - int(math.log2(fragments))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i, lefts, right, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), _sets(batch.column(1), k)):
                cuts = np.searchsorted(tokens, np.arange(1, fragments, dtype=np.uint64) << np.uint64(width))
                parts = [(f, p.view(np.int64)) for f, p in enumerate(np.split(tokens, cuts)) if len(p) and low <= f < high]
                for other in [*(lefts or []), *([None] if right else [])]:
                    held += [(i, other, f, p) for f, p in parts]
                    size += sum(len(p) for _, p in parts)
                    if size > CUT:
                        yield _rows(held)
                        held, size = [], 0
            if held:
                yield _rows(held)
    return run


def _rows(held) -> pa.RecordBatch:
    ids, others, fragment, tokens = zip(*held)
    bounds = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(fragment, pa.int32()),
         pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(tokens)))], ["id", "other", "fragment", "tokens"])


def _overlaps(texts: DataFrame, pairs: DataFrame, k: int, fragments: int, low: int, high: int) -> DataFrame:
    """(a, b, shared, seen_a, seen_b) of the pairs (a, b): overlaps are counted in each of the
    fragments low .. high-1 alone and summed; seen is how much of a side met the other there."""
    asked = pairs.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("lefts"), F.lit(False).alias("right")) \
        .unionByName(pairs.select(F.col("a").alias("id")).distinct().select("id", F.lit(None).cast("array<bigint>").alias("lefts"), F.lit(True).alias("right")))
    asked = scratch.keep(asked.groupBy("id").agg(F.max("lefts").alias("lefts"), F.max("right").alias("right")), "asked")
    near = scratch.narrow(texts, "id", asked.select("id"))
    cut = near.join(asked, "id").select("id", F.col("text").cast("binary").alias("text"), "lefts", "right") \
        .mapInArrow(_fragments(k, fragments, low, high), "id bigint, other bigint, fragment int, tokens array<bigint>")
    left = cut.filter("other is null").select(F.col("id").alias("a"), "fragment", F.col("tokens").alias("tokens_a"))
    right = cut.filter("other is not null").select(F.col("other").alias("a"), "fragment", F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))
    partial = right.join(left, ["a", "fragment"]).select(
        "a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("part"), F.size("tokens_a").alias("part_a"), F.size("tokens_b").alias("part_b"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("shared"), F.sum("part_a").alias("seen_a"), F.sum("part_b").alias("seen_b"))


def compared(texts: DataFrame, pairs: DataFrame, k: int = WORDS, least: int = LEAST, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b, n_a, n_b, low, high, linked) of the pairs (a, b, n_a, n_b): bounds of the overlap, equal
    where it was counted to the end.  After the first quarter of the fragments, pairs that cannot
    reach the threshold any more are left alone."""
    early = max(1, fragments // 4)
    need = (F.col("n_a") + F.col("n_b")) * least
    first = _overlaps(texts, pairs.select("a", "b"), k, fragments, 0, early)
    some = pairs.join(first, ["a", "b"], "left").na.fill(0, ["shared", "seen_a", "seen_b"])
    most = F.col("shared") + F.least(F.col("n_a") - F.col("seen_a"), F.col("n_b") - F.col("seen_b"))
    some = scratch.keep(some.select("a", "b", "n_a", "n_b", F.col("shared").alias("low"), most.alias("high"), (most * (100 + least) >= need).alias("open")), "begun")
    rest = _overlaps(texts, some.filter("open").select("a", "b"), k, fragments, early, fragments).select("a", "b", F.col("shared").alias("later"))
    both = some.join(rest, ["a", "b"], "left").withColumn("low", F.col("low") + F.when(F.col("open"), F.coalesce("later", F.lit(0))).otherwise(0))
    return both.withColumn("high", F.when(F.col("open"), F.col("low")).otherwise(F.col("high"))) \
        .withColumn("linked", F.col("open") & (F.col("low") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("low")) * least)) \
        .select("a", "b", "n_a", "n_b", "low", "high", "linked")


SIDE = ("rep", "n", "at", "most", "complete")


def _may_reach(a, b, least: int):
    """Whether two sets that share a prefix shingle can reach the threshold; a and b give the columns
    of `SIDE`.  What precedes and follows the shingle bounds the overlap, and so does `most`, the
    shingles of a set that occur anywhere else, if the other's prefix holds all its rare shingles."""
    low, high = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
    near = F.least(a("at"), b("at")) + F.least(a("n") - a("at"), b("n") - b("at"))
    held_a = F.when(b("complete"), a("most")).otherwise(a("n"))
    held_b = F.when(a("complete"), b("most")).otherwise(b("n"))
    return (low * 100 >= high * least) & (F.least(near, held_a, held_b) * (100 + least) >= (a("n") + b("n")) * least)


def _may_reach_by_hub(a, b, least: int):
    """Whether two sets that were compared with one hub can reach the threshold: what they share lies
    in the hub, so in the smaller of the two overlaps with it, or outside of it in both.  An overlap
    is taken off `most` only if the hub is complete: else it can hold shingles `most` has left out."""
    def outside(x, other):
        rest = x("n") - x("low")
        return F.when(other("complete"), F.when(x("whole"), x("most") - x("low")).otherwise(F.least(x("most"), rest))).otherwise(rest)
    out_a, out_b = outside(a, b), outside(b, a)
    most = F.least(a("high"), b("high")) + F.greatest(F.least(out_a, out_b), F.lit(0))
    return ~F.coalesce(a("hub") == b("hub"), F.lit(False)) | (most * (100 + least) >= (a("n") + b("n")) * least)


def _may_reach_by_count(least: int):
    """Whether a pair that shares `lists` prefix shingles, the last of them at places `last` and
    `last_b`, can reach the threshold.  What is shared up to that one is counted whole: it precedes it
    in both orders, so lies in both prefixes.  Of what follows, the rest of the prefix that ends first
    lies within the other's prefix and is not shared, whichever of the two that is."""
    after, after_b = F.col("n_a") - F.col("last") - 1, F.col("n_b") - F.col("last_b") - 1
    beyond, beyond_b = (F.ceil(F.col(n) * least / 100) - 1 for n in ("n_a", "n_b"))
    most = F.col("lists") + F.greatest(F.least(beyond, after_b), F.least(after, beyond_b))
    return most * (100 + least) >= (F.col("n_a") + F.col("n_b")) * least


def profiled(met: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(token, rep, n, at, most, complete) of the prefix shingles that several classes have.

    Of a class's rare prefix shingles, those that no other class has in its prefix are counted out in
    `most`.  `complete` tells that the prefix goes beyond the rare shingles, so holds them all."""
    own = scratch.keep(met.filter("salt >= 0").join(members, "id").select("token", F.expr("salt = 0").alias("rare"), "rep", "n", "at").distinct(), "own")
    several = own.groupBy("token").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("token")
    own = scratch.keep(own.join(several, "token", "left_semi"), "several")
    rare = met.filter("salt = -1").join(members, "id").groupBy("rep", "n").agg(F.max("at").alias("rare"))
    seen = own.groupBy("rep").agg(F.count_if("rare").alias("seen"))
    prefix = F.col("n") - F.ceil(F.col("n") * least / 100) + 1
    sides = rare.join(seen, "rep").select(
        "rep", (F.col("n") - F.col("rare") + F.col("seen")).alias("most"), ((F.col("rare") < prefix) & (F.col("rare") < FAR)).alias("complete"))
    return own.join(sides, "rep").select("token", *SIDE)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: int = LEAST,
                fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = texts.select("id", F.col("text").cast("binary").alias("text"))
    survey = scratch.keep(raw.mapInArrow(_survey(k), "kind int, id bigint, n bigint, digest binary"), "survey")
    sizes = survey.filter("kind = 0").select("id", "n", "digest")
    counts = survey.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    frequent = counts.orderBy(F.desc("n"), "id").limit(RANKED).orderBy("n", "id").select("id").toArrow()["id"].to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(frequent)
    classes = sizes.filter("n > 0 and id is not null").groupBy("digest", "n").agg(F.min("id").alias("rep"))
    members = scratch.keep(sizes.join(classes, ["digest", "n"]).select("id", "rep", "n"), "members")

    # prefix shingles that occur in more than one text
    entries = raw.mapInArrow(_prefixes(k, least, shared), "token bigint, salt short, id bigint, at short")
    alike = F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))
    met = scratch.keep(entries.withColumn("alike", alike).filter("alike > 1 or salt <> 0").drop("alike"), "met")
    own = scratch.keep(profiled(met, members, least), "sides")

    # one hub per list; each text is compared with the hub that it shares most lists with among those
    # that it could link with, and with the most popular of its hubs if that has many texts: only
    # there do bounds by a common hub save many pairs
    hubs = own.groupBy("token").agg(F.min(F.struct("at", "rep", "n", "most", "complete")).alias("hub"))
    fits = _may_reach(lambda c: F.col(f"hub.{c}"), F.col, least)
    spokes = scratch.keep(
        own.join(hubs, "token").filter("rep <> hub.rep").groupBy("rep", "n", F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"))
        .agg(F.count(F.lit(1)).alias("lists"), F.max(fits).alias("fits"), F.max("hub.complete").alias("whole")), "spokes")
    best = F.max(F.struct("lists", "a", "n_a"))
    near = spokes.filter("fits").groupBy("rep", "n").agg(best.alias("s")).select("s.a", F.col("rep").alias("b"), "s.n_a", F.col("n").alias("n_b"))
    alike = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * least
    popular = spokes.groupBy("a").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= POPULAR)
    common = scratch.keep(spokes.filter(alike).join(popular, "a").groupBy("rep", "n").agg(F.max(F.struct("texts", "a", "n_a", "whole")).alias("s"))
                          .select("s.a", F.col("rep").alias("b"), "s.n_a", F.col("n").alias("n_b"), "s.whole"), "common")
    stars = scratch.keep(compared(texts, near.unionByName(common.drop("whole")).distinct(), k, least, fragments), "compared")
    links = stars.filter("linked").select("a", "b")
    roots = components(links)
    measured = stars.join(common.select("a", "b", "whole"), ["a", "b"]).select(F.col("b").alias("rep"), F.col("a").alias("hub"), "low", "high", "whole")

    # every other pair that could still join two components; a shared shingle whose places rule a pair
    # out is not counted, which can only lower the count of a pair that is no link anyway
    own = own.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")) \
        .join(measured, "rep", "left")
    own = scratch.keep(own, "rooted")
    mixed = own.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("greatest")).filter("least <> greatest").select("token")
    left = own.join(mixed, "token", "left_semi")
    right = left.withColumnsRenamed({c: f"{c}_b" for c in (*SIDE, "root", "hub", "low", "high", "whole")})
    own_b = lambda c: F.col(f"{c}_b")
    rest = left.join(right, "token").filter((F.col("rep") < F.col("rep_b")) & (F.col("root") != F.col("root_b"))
                                            & _may_reach(F.col, own_b, least) & _may_reach_by_hub(F.col, own_b, least)) \
        .groupBy(F.col("rep").alias("a"), F.col("rep_b").alias("b"), F.col("n").alias("n_a"), "n_b") \
        .agg(F.count(F.lit(1)).alias("lists"), F.max("at").alias("last"), F.max("at_b").alias("last_b")) \
        .filter(_may_reach_by_count(least)).select("a", "b", "n_a", "n_b")
    tried = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = scratch.keep(rest.join(tried, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        more = scratch.keep(compared(texts, second, k, least, fragments).filter("linked").select("a", "b"), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    named = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    return sizes.join(named, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id.  Rows are told apart
    by id and text, so different texts of one id are linked each on its own; of rows that repeat both,
    one stays; rows with a null id stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine, theirs = scratch.fresh(docs, "row_hash", "kept_hash")
    hashed = docs.withColumn(mine, F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text)))
    rows = hashed.filter(F.col(mine).isNotNull()).select(F.col(id_col).alias("id"), F.col(mine).alias("row"), F.col(text_col).alias("text"))
    groups = scratch.keep(near_groups(rows, "row", "text", **options).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "groups")
    names = rows.select("id", "row").join(groups.distinct(), "row")
    firsts = scratch.keep(names.groupBy("component").agg(F.min(F.struct("id", "row")).alias("f")).select(F.col("f.row").alias(theirs)), "firsts")
    out = hashed.filter(F.col(mine).isNotNull()).join(firsts, F.col(mine) == F.col(theirs), "left_semi")
    if not groups.groupBy("row").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([mine])
    return out.unionByName(hashed.filter(F.col(mine).isNull())).drop(mine)
