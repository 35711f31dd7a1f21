"""Order-dependent operators that stay parallel when one key holds most of the rows.

A plain `partitionBy(key).orderBy(...)` window sends a whole key to one task.  Here a key is
first cut into blocks by a value that is monotone in the sort order (an hour, a frame range, a
histogram bin).  Each block is ranked on its own and the few block totals supply the offsets,
so the result is exact and no task sees more than one block.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 8192
PARTS = 32


def _offsets(df: DataFrame, keys: list[str], block: str, amount: Column, name: str) -> DataFrame:
    """Total of `amount` over the blocks that precede each block of a key."""
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(F.sum(amount).alias("_t"))
    return totals.select(*keys, block, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(name))


def running_total(df: DataFrame, keys: list[str], block: str, order: list,
                  amount: Column, name: str) -> DataFrame:
    """Exact running total of `amount` up to and including each row.  Keys must not be null."""
    local = W.partitionBy(*keys, block).orderBy(*order) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = _offsets(df, keys, block, amount, "_before")
    return (df.withColumn("_local", F.sum(amount).over(local))
            .join(offsets, keys + [block])
            .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
            .drop("_local", "_before"))


def ordinals(df: DataFrame, keys: list[str], block: str, order: list,
             name: str = "ordinal") -> DataFrame:
    """Exact row number of each row within its key."""
    return running_total(df, keys, block, order, F.lit(1), name)


def chunked(df: DataFrame, keys: list[str], ordinal: str, lookback: int,
            chunk: int = CHUNK) -> DataFrame:
    """Cut each key into fixed-size chunks and copy the last `lookback` rows of a chunk into
    the next one, so a `rowsBetween(-lookback, ...)` window partitioned by (keys, _chunk) sees
    what a window over the whole key would.  Drop the copies afterwards with `own_rows`.  A chunk
    is never shorter than the look-back, else a window would reach past the copies."""
    chunk = max(chunk, lookback)
    at = F.floor((F.col(ordinal) - 1) / chunk)
    near_end = (F.col(ordinal) - 1) % chunk >= chunk - lookback
    return (df.withColumn("_home", at)
            .withColumn("_chunk", F.explode(
                F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at)))))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def join_few(many: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of any number of rows per key with one row per key.  Each of the few is copied to
    every part a key is cut into, so no task gets a whole key, however many keys there are."""
    part = F.pmod(F.xxhash64(spread), F.lit(PARTS))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    return many.withColumn("_part", part).join(copies, [*keys, "_part"]).drop("_part")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value occurs per key, as `_c`; null is no value."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column],
              bins: int = 1024) -> DataFrame:
    """Exact order statistics per key, of the rows of `df`."""
    return counted_values_at(value_counts(df, keys, value), keys, value, ranks, bins)


def counted_values_at(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, Column],
                      bins: int = 1024) -> DataFrame:
    """Exact order statistics per key, of values with their counts.

    `ranks` maps an output name to a 1-based rank, an expression over the key's row count `n`.
    Equal values are counted before they travel.  A histogram then names the bin that holds each
    rank, and only the distinct values of those bins are ordered.  Bins are octaves of the distance
    from the key's least value, each cut into `bins` parts of equal width, so a heavy tail does not
    press all other values into one bin; infinite values have bins of their own.
    """
    finite = F.col(value).between(-sys.float_info.max, sys.float_info.max)
    span = counts.groupBy(*keys).agg(F.min(F.when(finite, F.col(value))).alias("_lo"), F.sum("_c").alias("n"))
    far = F.greatest(F.col(value) - F.coalesce("_lo", F.lit(0.0)), F.lit(2.0 ** -40))
    octave = F.floor(F.log2(far))
    inside = F.least(F.floor((far / F.pow(F.lit(2.0), octave) - 1) * bins), F.lit(bins - 1))
    binned = join_few(counts, span, keys, value).withColumn(
        "_bin", F.when(finite, octave * bins + inside).otherwise(
            F.when(F.col(value) < 0, F.lit(-(1 << 40))).otherwise(F.lit(1 << 40))).cast("bigint"))
    hist = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"), F.max("n").alias("n"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank"))
                       for k, r in ranks.items()])
    targets = (hist.withColumn("_end", F.sum("_bc").over(upto))
               .withColumn("_want", F.explode(wanted))
               .filter((F.col("_want.rank") <= F.col("_end"))
                       & (F.col("_want.rank") > F.col("_end") - F.col("_bc")))
               .select(*keys, "_bin", F.col("_want.name").alias("_name"),
                       (F.col("_want.rank") - (F.col("_end") - F.col("_bc"))).alias("_within"),
                       "n"))
    inside = W.partitionBy(*keys, "_bin").orderBy(value) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    bins_wanted = targets.select(*keys, "_bin").distinct()
    ordered = (binned.select(*keys, "_bin", value, "_c").join(bins_wanted, keys + ["_bin"])
               .withColumn("_e", F.sum("_c").over(inside)))
    hit = (ordered.join(targets, keys + ["_bin"])
           .filter((F.col("_within") <= F.col("_e"))
                   & (F.col("_within") > F.col("_e") - F.col("_c"))))
    return hit.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in ranks])


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key; an even count averages the middle pair."""
    return counted_median(value_counts(df, keys, value), keys, value, name)


def counted_median(counts: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The same of values with their counts."""
    n = F.col("n")
    both = counted_values_at(counts, keys, value, {"_m1": F.floor((n + 1) / 2), "_m2": F.floor(n / 2) + 1})
    return both.withColumn(name, (F.col("_m1") + F.col("_m2")) / 2).drop("_m1", "_m2")


def running_max(df: DataFrame, keys: list[str], block: str, order: list, value: Column,
                name: str, before: bool = False) -> DataFrame:
    """Exact running maximum up to each row, or up to the row before it.  Keys must not be null."""
    local = W.partitionBy(*keys, block).orderBy(*order) \
        .rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    tops = df.groupBy(*keys, block).agg(F.max(value).alias("_m")) \
        .select(*keys, block, F.max("_m").over(earlier).alias("_above"))
    return (df.withColumn("_local", F.max(value).over(local)).join(tops, keys + [block])
            .withColumn(name, F.greatest("_local", "_above")).drop("_local", "_above"))
