"""Mixing sources to target weights by entropy balancing.

Every document may be taken 0, 1 or 2 times.  Its expected copies are an exponentially tilted
binomial: with base share q and x = size / mean size of its source,

    rate = 2 * q * exp(l * x) / (1 - q + q * exp(l * x)),

the distribution closest (in relative entropy) to taking everything at the base share among those
whose expected words equal the source's target.  The multiplier l of each source solves the convex
dual; its gradient and curvature are sums over all documents, taken in parallel from a table of
sizes, one Newton step for all sources at a time.  Sums are of fixed-point integers, so a rerun
finds the same multipliers whatever order tasks finish in.

Rates become copies by systematic rounding along each source ordered by size: neighbours have
nearly the same size, so a source's words miss its target by about one long document at most.
Shorter documents fill that gap, as many as it takes; where they do not suffice, one longer document
is changed as well and shorter ones make up for its excess.

Defined results: null text has size 0; null source is a source of its own, ordered last; a source
without words has target 0; rows that repeat an id are documents of their own; an empty table gives
an empty result; other columns are not read by `plan`.  A source is a crawl or data set: one row per
source is ordered in one task, never one per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepost.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: fixed point of rates and of the Newton sums
UNIT = 1 << 20
TERM = 1 << 10
STEPS, STEP, EXACT = 60, 4.0, 1e-7
#: documents of one source and size that one task numbers, about
NUMBERED = 100_000
#: the documents of a power of two of size are tried by so many blocks (a power of two), the blocks of
#: a block again, until blocks are single documents
BLOCKS = 64


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight in code point order, none above
    `most` times its source; the excess is shared again.  Sources fill up in the order of
    size / weight, so the level at which the rest stands is found in one pass."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)) \
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(share)
             - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    line = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return filled.withColumn("line", line).select(
        "source", "source_size", "docs", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("line"), F.col("cap"))).alias("target"))


def _share(size: Column, mean: Column, tilt: Column, base: float) -> Column:
    odds = base / (1 - base)
    return 1 / (1 + F.exp(-tilt * size / mean) / F.lit(odds))


def multipliers(sizes: DataFrame, goals: DataFrame, most: int = MOST, base: float | None = None) -> DataFrame:
    """(source, source_size, target, mean, base, tilt) by Newton steps kept inside a shrinking bracket.

    A source that takes everything `most` times (or nothing) has no finite multiplier: tilt is null."""
    base = SHARE / MOST if base is None else base
    state = goals.withColumns({
        "mean": F.greatest(F.col("source_size") / F.greatest(F.col("docs"), F.lit(1)), F.lit(1e-9)), "base": F.lit(base),
        "tilt": F.when((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-9)), F.lit(0.0)),
        "low": F.lit(-1e6), "high": F.lit(1e6)})
    state = scratch.keep(state, "tilt")
    for _ in range(STEPS):
        share = _share(F.col("size"), F.col("mean"), F.col("tilt"), base)
        words = F.col("n") * F.col("size") * most
        fixed = lambda c: F.sum(F.round(c * TERM).cast("bigint"))
        sums = (sizes.join(state.filter("tilt is not null").select("source", "mean", "tilt"), sizes["source"].eqNullSafe(state["source"]))
                .select(sizes["source"].alias("key"), (words * share).alias("w"),
                        (words * F.col("size") / F.col("mean") * share * (1 - share)).alias("c"))
                .groupBy("key").agg((fixed(F.col("w")) / TERM).alias("taken"), (fixed(F.col("c")) / TERM).alias("slope")))
        gap = F.col("taken") - F.col("target")
        move = F.greatest(F.least(F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-12)), F.col("tilt") + STEP), F.col("tilt") - STEP)
        stepped = state.join(sums, state["source"].eqNullSafe(sums["key"]), "left") \
            .withColumns({"low": F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")),
                          "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")),
                          "error": F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)), "to": move}) \
            .withColumn("tilt", F.when(F.col("tilt").isNull() | (F.col("error") <= EXACT), F.col("tilt"))
                        .when((F.col("to") > F.col("low")) & (F.col("to") < F.col("high")), F.col("to"))
                        .otherwise((F.col("low") + F.col("high")) / 2)) \
            .select(*state.columns, "error")
        state = scratch.keep(stepped, "tilt")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= EXACT:
            break
        state = state.drop("error")
    return state.select("source", "source_size", "target", "mean", "base", "tilt")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per row of `docs`."""
    sized = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sized")
    sizes = scratch.keep(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    tilts = multipliers(sizes, targets(sources, weights, share, most), most)
    rate = F.when(F.col("tilt").isNotNull(), most * _share(F.col("size"), F.col("mean"), F.col("tilt"), SHARE / MOST)) \
        .when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    salts = max(1, sizes.agg(F.max("n")).first()[0] or 0) // NUMBERED + 1
    keyed = sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    counts = keyed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    fixed = counts.join(tilts.withColumnRenamed("source", "of"), counts["source"].eqNullSafe(F.col("of"))) \
        .withColumn("unit", F.round(rate * UNIT).cast("bigint"))
    line = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("unit")).over(line), F.lit(0))) \
        .select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), "start", "unit", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id")).cast("bigint")
    placed = keyed.withColumn("place", place)
    at = lambda k: F.floor((F.col("start") + k * F.col("unit") + UNIT // 2) / UNIT)
    rows = (placed.join(starts, placed["source"].eqNullSafe(starts["of"]) & (placed["size"] == starts["of_size"]) & (placed["part"] == starts["of_part"]))
            .withColumn("copies", (at(F.col("place")) - at(F.col("place") - 1)).cast("int"))
            .select("doc_id", "source", "size", "part", "place", F.col("source_size").cast("bigint").alias("source_size"), "target",
                    (F.col("unit") / UNIT).alias("rate"), "copies"))
    rows = scratch.keep(rows, "rounded")
    filled = _fill(rows, _gaps(rows), most)
    return filled.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


PLACE = ("source", "size", "part", "place")


def _gaps(rows: DataFrame) -> DataFrame:
    """(of, gap): words that a source lacks to its target, negative where it has more."""
    return rows.groupBy(F.col("source").alias("of")).agg(F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("bigint").alias("gap"))


def _changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """`rows` with the changes (of_source, of_size, of_part, of_place, change) in their copies."""
    same = [rows[c].eqNullSafe(changes[f"of_{c}"]) for c in PLACE]
    return rows.join(changes, same, "left").withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int")).select(*rows.columns)


def _fill(rows: DataFrame, gaps: DataFrame, most: int) -> DataFrame:
    """`rows` with the copies changed so that sources meet their targets.

    A source that stays off by one of its shortest texts or more has no room left in texts below the
    gap.  There one text above the gap is changed too and the excess is taken back from shorter ones;
    that stands if it comes closer."""
    gaps = scratch.keep(gaps, "gaps")
    once = scratch.keep(_changed(rows, _mend(rows, gaps, most)), "mended")
    left = scratch.keep(_gaps(once), "gaps")
    shortest = rows.filter("size > 0").groupBy(F.col("source").alias("from")).agg(F.min("size").alias("shortest"))
    off = left.join(shortest, left["of"].eqNullSafe(F.col("from"))).filter(F.abs("gap") >= F.col("shortest")).select("of", "gap")
    off = scratch.keep(off, "off")
    if off.isEmpty():
        return once
    some = once.join(off, once["source"].eqNullSafe(off["of"]))
    sign = F.signum("gap").cast("int")
    above = some.filter((F.col("size") > F.abs("gap")) & (F.col("copies") + sign).between(0, most)) \
        .groupBy("of").agg(F.min(F.struct(F.col("size"), F.xxhash64(*PLACE).alias("hash"), *PLACE[2:], sign.alias("change"))).alias("x")) \
        .select(F.col("of").alias("of_source"), *[F.col(f"x.{c}").alias(f"of_{c}") for c in PLACE[1:]], "x.change")
    moved = scratch.keep(_changed(some.select(*rows.columns), above), "moved")
    over = scratch.keep(_gaps(moved), "gaps")
    twice = scratch.keep(_changed(moved, _mend(moved, over, most)), "mended")
    closer = _gaps(twice).select(F.col("of").alias("to"), F.col("gap").alias("next")).join(off, F.col("to").eqNullSafe(F.col("of"))) \
        .filter(F.abs("next") < F.abs("gap")).select("of")
    closer = scratch.keep(closer, "closer")
    return once.join(closer, once["source"].eqNullSafe(closer["of"]), "left_anti") \
        .unionByName(twice.join(closer, twice["source"].eqNullSafe(closer["of"]), "left_semi"))


def _mend(rows: DataFrame, gaps: DataFrame, most: int) -> DataFrame:
    """(of_source, of_size, of_part, of_place, change): documents that get copies more or less so that
    their source meets its target closely.

    Every copy that a document has room for is one item, in octaves of size, longest first, and in
    hashed order.  Blocks of items are taken while they fit; of the blocks of an octave that do not,
    one is cut into blocks anew.  A block left out is larger than what is left of the gap, so the one
    that is cut suffices to fill it, and in the end what is left is less than one document of it."""
    gaps = gaps.filter("gap <> 0")
    room = F.when(F.col("gap") > 0, most - F.col("copies")).otherwise(F.col("copies"))
    items = rows.join(gaps, rows["source"].eqNullSafe(gaps["of"])).filter((F.col("size") > 0) & (F.col("size") <= F.abs("gap"))).withColumn("room", room) \
        .filter("room > 0").select(*PLACE, F.signum("gap").cast("int").alias("change"), F.explode(F.sequence(F.lit(1), F.col("room"))).alias("copy")) \
        .withColumns({"octave": F.floor(F.log2("size")).cast("int"), "hash": F.xxhash64(*PLACE, "copy")})
    open_ = scratch.keep(items, "items")
    state = scratch.keep(gaps.select(F.col("of").alias("whose"), F.abs("gap").alias("left")), "left")
    bits = BLOCKS.bit_length() - 1
    taken = None
    for at in range(0, 64, bits):
        open_ = open_.withColumn("block", F.shiftrightunsigned("hash", at).bitwiseAND(F.lit(BLOCKS - 1)).cast("int"))
        blocks = open_.groupBy("source", "octave", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        entry = F.struct((-F.col("octave")).alias("octave"), "block", "words", "n")
        folded = blocks.groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        folded = folded.join(state, folded["source"].eqNullSafe(state["whose"])).select("source", F.expr("""aggregate(entries,
            struct(left AS left, filter(entries, e -> false) AS took, filter(entries, e -> false) AS cut),
            (acc, e) -> CASE WHEN e.words <= acc.left THEN struct(acc.left - e.words AS left, concat(acc.took, array(e)) AS took, acc.cut AS cut)
                WHEN e.n > 1 AND (size(acc.cut) = 0 OR element_at(acc.cut, -1).octave <> e.octave) THEN struct(acc.left AS left, acc.took AS took, concat(acc.cut, array(e)) AS cut)
                ELSE acc END)""").alias("r"))
        folded = scratch.keep(folded.select("source", "r.*"), "folded")
        state = folded.select(F.col("source").alias("whose"), "left")
        chosen = lambda name: folded.select(F.col("source").alias("whose"), F.inline(name)).select(
            "whose", (-F.col("octave")).alias("of_octave"), F.col("block").alias("of_block"))
        within = lambda c: open_.join(c, open_["source"].eqNullSafe(c["whose"]) & (open_["octave"] == c["of_octave"])
                                      & (open_["block"] == c["of_block"]), "left_semi")
        took = within(chosen("took")).select(*PLACE, "change")
        taken = took if taken is None else taken.unionByName(took)
        cut = chosen("cut")
        if cut.isEmpty():
            break
        open_ = scratch.keep(within(cut).drop("block"), "items")
    return taken.groupBy(*[F.col(c).alias(f"of_{c}") for c in PLACE]).agg(F.sum("change").cast("int").alias("change"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: each row of `docs` as often as it is taken, with all its columns.  Rows that
    repeat an id share that id's copies evenly."""
    whose, every, rows, place, taken, copy = scratch.fresh(docs, "mix_id", "mix_all", "mix_rows", "mix_place", "mix_taken", "mix_copy")
    own = scratch.keep(plan(docs, id_col, text_col, source_col, **options).groupBy("doc_id")
                       .agg(F.sum("copies").alias(every), F.count(F.lit(1)).alias(rows))
                       .withColumnRenamed("doc_id", whose), "copies")
    joined = docs.join(own, docs[id_col].eqNullSafe(own[whose]))
    copies = F.col(every)
    if not own.filter(F.col(rows) > 1).isEmpty():
        joined = joined.withColumn(place, F.row_number().over(Window.partitionBy(whose).orderBy(F.xxhash64(text_col, source_col))))
        copies = F.floor(F.col(every) / F.col(rows)) + F.when(F.col(place) <= F.col(every) % F.col(rows), 1).otherwise(0)
    return joined.withColumn(taken, copies.cast("int")).filter(F.col(taken) > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*docs.columns)
