"""Near-duplicate classes by circulant MinHash, banding and verification on full sets.

Two permutations make a whole signature.  The first scatters shingles over `SPACE` places (a fixed
mixing of their 64-bit hashes); the second is one table of `SPACE` values.  Coordinate k of a set is
the least value at the places of its shingles shifted by k around the circle, so 128 coordinates
need one table and one pass, not 128 hash functions.  Bands of four coordinates are hashed to
buckets: a pair at the threshold misses all 32 with odds of about 5 in 10**8 (0.59**32), a better
pair less.  Every link is confirmed on the full sets.

Pairs are not spread out within buckets:

* Equal sets are one class, whatever their number.
* In each bucket the member that shares most buckets with others is the hub, and each class is
  compared with its hubs.  The links give first components.
* Two classes x and y that met in a bucket have its hub h in common, so |x & y| is |x & h| + |y & h| -
  |h| + the shared part of their differences from h.  Where a hub's classes are in several
  components, differences alone are joined: for x without a link to h and y of another component to
  link, they must share so many that the rarest of each, all but that many, hold one in common.
  Copies edited in different places share none, however many they are.

Shingles are 64-bit hashes: two of 10**10 different ones are equal with odds of about 3 in a thousand,
and one such pair changes an overlap by one.

Defined results: null and empty texts, and texts without words, have no shingles, link with nothing and
keep themselves; with fewer than `k` words the whole sequence is one shingle; rows that repeat a text
are one class; rows that repeat an id get one row each, and the smallest component of that id's
texts (different texts of one id stay different sets); a null id has component null, links nobody and is
kept; ties between hubs go to the class numbered first and change no link; a text of any length is hashed
in pieces (8 bytes a word in memory), and one whose set fills the places only meets more candidates; an
empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch, words
from wirepost.llm.components import components

WORDS = 2
#: similarity threshold in percent
LEAST = 80
BANDS, ROWS = 32, 4
#: places of the circle (a table of 4 bytes each in every worker)
SPACE = 1 << 20
SEED = 20120
#: shingles whose windows of the table are reduced together
STEP = 2048
#: shingles of sets sent on together
SENT = 1 << 18


@functools.lru_cache(maxsize=1)
def circle(size: int = SPACE, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Row p holds the second permutation's values at places p, p+1, .. around the circle (a view)."""
    table = np.random.Generator(np.random.PCG64(SEED)).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates - 1]]), coordinates)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The coordinates of one set of shingle hashes (not empty)."""
    windows = circle()
    places = (words.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(SPACE - 1)).astype(np.int64)
    best = np.full(windows.shape[1], 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), STEP):
        np.minimum(best, windows[places[at:at + STEP]].min(axis=0), out=best)
    return best


def buckets(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band (columns) of each signature (rows)."""
    grid = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), grid.shape[:2]).copy()
    for r in range(ROWS):
        out = words.mix(out ^ (grid[:, :, r] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    return out


def _sets(column: pa.Array, k: int):
    """Distinct shingle hashes (ascending) of each text, in row order."""
    for _, hashes, bounds in words.hashed(column, lower=True):
        every = words.grams(hashes, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(every[a:b - k + 1])
            else:
                yield words.grams(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _surveyed(k: int):
    """(id, key, n, digest of the set, buckets) of each text; a set without shingles has no buckets."""
    def run(batches):
        for batch in batches:
            n, digests, signed = [], [], []
            for tokens in _sets(batch.column(2), k):
                n.append(len(tokens))
                digests.append(_digest(tokens))
                if len(tokens):
                    signed.append(signature(tokens))
            found = buckets(np.array(signed)).view(np.int64).ravel() if signed else np.empty(0, np.int64)
            bounds = np.cumsum([0, *(BANDS if m else 0 for m in n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(found))], ["id", "key", "n", "digest", "buckets"])
    return run


def _tokens(k: int):
    """(rep, other, tokens): each set once for every hub it is asked to meet, and once alone (other
    null) if it is itself a hub."""
    def sent(held):
        ids, others, sets = zip(*held)
        bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets)))],
            ["rep", "other", "tokens"])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i, digest, hubs, alone, own in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), _sets(batch.column(1), k)):
                if _digest(own) != digest:  # another text of the same key
                    continue
                for other in [*(hubs or []), *([None] if alone else [])]:
                    held.append((i, other, own.view(np.int64)))
                    size += len(own)
                    if size > SENT:
                        yield sent(held)
                        held, size = [], 0
            if held:
                yield sent(held)
    return run


class Texts:
    """The texts of the classes' representatives, found by a hash of the row (id and text)."""

    def __init__(self, rows: DataFrame, classes: DataFrame, repeated: bool):
        self.rows, self.classes, self.repeated = rows, classes, repeated

    def of(self, asked: DataFrame) -> DataFrame:
        """(rep, text as bytes, digest, other columns of `asked`) of the asked classes (rep, ..)."""
        asked = scratch.keep(asked.join(self.classes.select("rep", "key", "digest"), "rep"), "asked")
        found = scratch.narrow(self.rows, "key", asked.select("key"))
        if self.repeated:
            found = found.dropDuplicates(["key", "text"])
        return found.join(asked, "key").select("rep", F.col("text").cast("binary").alias("text"), "digest",
                                               *[c for c in asked.columns if c not in ("rep", "key", "digest")])


def measured(texts: Texts, pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, n_a, n_b, shared, differ) of the pairs (a, b, n_a, n_b): the overlap of the full sets, and
    the shingles that only one of them has.  The set of b goes to where a's is, once per pair."""
    met = pairs.groupBy(F.col("b").alias("rep")).agg(F.collect_set("a").alias("hubs"), F.lit(False).alias("alone"))
    hubs = pairs.select(F.col("a").alias("rep")).distinct().select("rep", F.lit(None).cast("array<bigint>").alias("hubs"), F.lit(True).alias("alone"))
    asked = met.unionByName(hubs).groupBy("rep").agg(F.max("hubs").alias("hubs"), F.max("alone").alias("alone"))
    sets = texts.of(asked).mapInArrow(_tokens(k), "rep bigint, other bigint, tokens array<bigint>")
    left = sets.filter("other is null").select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.filter("other is not null").select(F.col("other").alias("a"), F.col("rep").alias("b"), F.col("tokens").alias("tokens_b"))
    only = F.concat(F.array_except("tokens_a", "tokens_b"), F.array_except("tokens_b", "tokens_a"))
    n_a, n_b = F.size("tokens_a").cast("long"), F.size("tokens_b").cast("long")
    return right.join(left, "a").select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), only.alias("differ")) \
        .select("a", "b", "n_a", "n_b", F.floor((F.col("n_a") + F.col("n_b") - F.size("differ")) / 2).alias("shared"), "differ")


def _linked(least: int):
    return F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * least


def by_differences(spokes: DataFrame, least: int) -> DataFrame:
    """(a, b): links between classes of one hub but of different components.

    `spokes` has (hub, hub_root, n_hub, rep, root, n, shared, differ).  With T = 100 + least, the
    differences of a linked pair x, y share at least (x.lack + y.far) / T, where lack is above 0
    unless x links with the hub, and far is never below 0."""
    total = 100 + least
    size = F.size("differ")
    spokes = spokes.withColumns({
        "lack": (F.col("n") + F.col("n_hub")) * least - F.col("shared") * total,
        "far": F.col("n") * least + F.col("n_hub") * 100 - F.col("shared") * total}) \
        .withColumns({"apart": F.col("root") != F.col("hub_root"),
                      "prefix": (F.when(F.col("root") != F.col("hub_root"), size - F.ceil(F.col("lack") / total) + 1).otherwise(size - F.floor(F.col("far") / total))).cast("int")})
    spokes = scratch.keep(spokes.withColumn("wide", (size - F.floor(F.col("far") / total)).cast("int")), "spokes")
    tokens = spokes.select("hub", "rep", F.explode("differ").alias("token"))
    often = scratch.keep(tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    ranked = tokens.join(often, ["hub", "token"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("order"))
    # what one class alone has comes before all that is shared, and can not meet
    slim = spokes.select("hub", "rep", "root", "n", "lack", "far", "apart", "prefix", "wide", size.alias("size"))
    placed = ranked.join(slim, ["hub", "rep"]).withColumn("alone", F.col("size") - F.size("order")) \
        .select("hub", "rep", "root", "n", "lack", "far", "apart", "prefix", "wide", "size", "alone", F.posexplode("order").alias("i", "o")) \
        .select("hub", "rep", "root", "n", "lack", "far", "apart", "prefix", "wide", "size", F.col("o.token").alias("token"), (F.col("alone") + F.col("i")).alias("at"))
    placed = scratch.keep(placed.filter(F.col("at") < F.greatest("prefix", "wide")), "placed")
    left = placed.filter(F.col("apart") & (F.col("at") < F.col("prefix")))
    right = placed.filter(F.col("at") < F.col("wide")).withColumnsRenamed({c: f"{c}_b" for c in placed.columns if c not in ("hub", "token")})
    rest = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    alike = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * least
    once = ~F.col("apart_b") | (F.col("rep") < F.col("rep_b"))
    met = left.join(right, ["hub", "token"]).filter((F.col("root") != F.col("root_b")) & once & alike & (rest * total >= F.col("lack") + F.col("far_b")))
    pairs = met.groupBy(F.col("rep").alias("x"), F.col("rep_b").alias("y")).agg(F.min("hub").alias("hub"), F.min_by(F.col("lack") + F.col("far_b"), "hub").alias("need"))
    pairs = scratch.keep(pairs, "open")
    own = lambda name: spokes.select("hub", F.col("rep").alias(name), F.col("differ").alias(f"differ_{name}"))
    return pairs.join(own("x"), ["hub", "x"]).join(own("y"), ["hub", "y"]) \
        .filter(F.size(F.array_intersect("differ_x", "differ_y")) * total >= F.col("need")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .select("id", F.xxhash64("id", "text").alias("key"), "text")
    survey = scratch.keep(rows.select("id", "key", F.col("text").cast("binary").alias("text"))
                          .mapInArrow(_surveyed(k), "id bigint, key bigint, n bigint, digest binary, buckets array<bigint>"), "survey")
    live = survey.filter("n > 0 and id is not null")
    # classes are numbered as they are written; their first row (least id) stands for them
    classes = live.groupBy("digest", "n").agg(F.min(F.struct("id", "key")).alias("f"), F.any_value("buckets").alias("buckets"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "n", F.col("f.id").alias("first"),
                                          F.col("f.key").alias("key"), "buckets"), "classes")
    repeated = not live.groupBy("key").count().filter("count > 1").isEmpty()
    texts = Texts(rows, classes, repeated)
    every = classes.select("rep", "n", F.explode("buckets").alias("bucket"))
    several = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    several = scratch.keep(several, "several")
    entries = scratch.keep(scratch.narrow(every, "bucket", several.select("bucket")).join(several, "bucket"), "entries")

    # each class meets the most popular member of each of its buckets
    popular = scratch.keep(entries.groupBy("rep").agg(F.sum("members").alias("weight")), "popular")
    weighed = entries.join(popular, "rep")
    hubs = scratch.keep(weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("h"))
                        .select("bucket", (-F.col("h.rep")).alias("hub")), "hubs")
    spokes = entries.join(hubs, "bucket").filter(F.col("rep") != F.col("hub")) \
        .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = scratch.keep(measured(texts, scratch.keep(spokes, "pairs"), k), "measured")
    links = stars.filter(_linked(least)).select("a", "b")
    roots = components(links)

    # hubs whose classes are still in several components
    rooted = lambda df, name: df.join(roots.select(F.col("id").alias(name), F.col("root").alias(f"root_{name}")), name, "left") \
        .withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
    known = scratch.keep(rooted(rooted(stars.select("a", "b"), "b"), "a"), "known")
    mixed = scratch.keep(known.filter("root_b <> root_a").select("a").distinct(), "mixed")
    if not mixed.isEmpty():
        open_ = stars.join(known.join(mixed, "a", "left_semi"), ["a", "b"]).select(
            F.col("a").alias("hub"), F.col("root_a").alias("hub_root"), F.col("n_a").alias("n_hub"), F.col("b").alias("rep"), F.col("root_b").alias("root"),
            F.col("n_b").alias("n"), "shared", "differ")
        more = scratch.keep(by_differences(open_, least), "more")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    # the smallest id of a component, then of all texts of an id
    whole = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = scratch.keep(whole.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = scratch.keep(whole.select("digest", "n", "root").join(smallest, "root").drop("root"), "named")
    found = live.select("id", "n", "digest").join(named, ["digest", "n"]).groupBy("id").agg(F.min("component").alias("component"))
    return survey.select("id", "n").join(found, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))
