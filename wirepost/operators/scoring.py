"""Score, band, priority and identity of an assessment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.operators import fusion

START = 100.0
MAX_MULTIPLIER = 2.0
MIN_ASSESSED = 0.5
MAX_RECURRENCE_BONUS = 8.0


def numeric(table: dict[str, float], col: Column) -> Column:
    out = F.lit(0.0)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def damped(recurrence: Column) -> Column:
    """Logarithmic in the affected sessions, and capped."""
    return F.when(recurrence <= 1, F.lit(1.0)) \
        .otherwise(F.least(F.lit(MAX_MULTIPLIER), 1.0 + F.log2(recurrence) / 4.0))


#: formula -> multiplier of a group, given its recurrence and its 0-based place in the capture
FORMULAS: dict[str, Callable[[Column, Column], Column]] = {
    "F1-instance": lambda n, place: n.cast("double"),
    "F2-group-damped": lambda n, place: damped(n),
    "F3-worst-dominant": lambda n, place: damped(n) * F.pow(F.lit(0.5), place),
}


def formula(formula_id: str) -> Callable[[Column, Column], Column]:
    if formula_id not in FORMULAS:
        raise ValueError(f"unknown scoring formula {formula_id!r}")
    return FORMULAS[formula_id]


def score(groups: DataFrame, formula_id: str = vocab.SELECTED_FORMULA,
          keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Score components: one per penalising group.  A capture has one group per class and kind,
    so ranking them is a small window."""
    multiplier = formula(formula_id)
    weight = numeric(vocab.SEVERITY_WEIGHT, F.col("severity"))
    w = W.partitionBy(*keys).orderBy(weight.desc(), F.col("recurrence").desc(), "issue_class",
                                     "fact_kind")
    ranked = groups.filter("penalising").withColumn("place", F.row_number().over(w) - 1)
    return ranked.withColumns({
        "base_weight": weight,
        "recurrence_multiplier": multiplier(F.col("recurrence"), F.col("place")),
    }).withColumn("penalty", F.col("base_weight") * F.col("recurrence_multiplier")) \
        .select(*keys, "issue_class", "fact_kind", "severity", "recurrence", "place",
                "base_weight", "recurrence_multiplier", "penalty")


def band(value: Column) -> Column:
    out = F.lit("CRITICAL")
    for cut, name in reversed(vocab.BAND_CUTS):
        out = F.when(value >= cut, name).otherwise(out)
    return out


def posture_score(groups: DataFrame, coverage: DataFrame,
                  formula_id: str = vocab.SELECTED_FORMULA,
                  keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """One score per scope.  The number stands whatever the coverage; the band is withheld when
    nothing, or less than half of the sessions, could be assessed."""
    penalties = score(groups, formula_id, keys).groupBy(*keys).agg(
        F.sum("penalty").alias("total_penalty"), F.count(F.lit(1)).alias("components"))
    joined = coverage.join(penalties, list(keys), "left")
    none = F.col("sessions_assessed") == 0
    penalty = F.when(none, 0.0).otherwise(F.coalesce("total_penalty", F.lit(0.0)))
    value = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), START - penalty))
    return joined.select(
        *keys, F.lit(formula_id).alias("formula_id"), value.alias("value"),
        F.when(none | (F.col("assessed_fraction") < MIN_ASSESSED), "INSUFFICIENT_EVIDENCE")
         .otherwise(band(value)).alias("band"),
        penalty.alias("total_penalty"),
        F.when(none, 0).otherwise(F.coalesce("components", F.lit(0))).alias("components"),
        "sessions_total", "sessions_assessed", "assessed_fraction")


def protocol_posture(sessions: DataFrame, classified: DataFrame, fused: DataFrame,
                     formula_id: str = vocab.SELECTED_FORMULA) -> DataFrame:
    """The same score on each protocol's own facts, with the dimensions they touch."""
    known = F.col("protocol").isNotNull()
    keys = ("capture_id", "protocol")
    groups = fusion.issue_groups(fused.filter(known), ("protocol",))
    cov = fusion.coverage(sessions.filter(known), classified.filter(known), ("protocol",))
    scored = posture_score(groups, cov, formula_id, keys)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    facets = groups.groupBy(*keys).agg(
        joined(F.when(F.col("penalising"), F.col("issue_class"))).alias("issue_classes"),
        joined(F.col("dimension")).alias("dimensions_assessed"),
        F.max(F.when(F.col("dimension") == "CERTIFICATE_TRUST", F.col("dimension")))
         .alias("dimensions_not_observable"))
    abst = classified.filter(known & (F.col("fact_kind") == "ABSTENTION")).groupBy(*keys) \
        .agg(F.count(F.lit(1)).alias("abstentions"))
    return scored.join(facets, list(keys), "left").join(abst, list(keys), "left") \
        .withColumn("abstentions", F.coalesce("abstentions", F.lit(0)))


def prioritise(groups: DataFrame, ai: bool = False) -> DataFrame:
    """Ranked groups.  The severity steps are wider than everything else together, so nothing
    can lift a group into the next severity."""
    n = F.col("recurrence")
    factors = {
        "severity_factor": numeric(vocab.SEVERITY_BASE, F.col("severity")),
        "certainty_factor": numeric(vocab.CERTAINTY_FACTOR, F.col("certainty")),
        "kind_factor": numeric(vocab.KIND_FACTOR, F.col("fact_kind")),
        "recurrence_factor": F.when(n <= 1, 0.0).otherwise(
            F.least(F.lit(MAX_RECURRENCE_BONUS), F.log2(n) * 2.0)),
        "standards_factor": F.when(F.size("citations") > 0, 3.0).otherwise(0.0),
        "actionable_factor": F.when(F.col("actionable"), 2.0).otherwise(0.0),
        "ml_adjustment": F.col("ml_nudge") if ai else F.lit(0.0),
    }
    out = groups.filter(F.col("fact_kind").isin(fusion.RANKABLE)).withColumns(factors)
    total = sum((F.col(c) for c in factors), F.lit(0.0))
    w = W.partitionBy("capture_id").orderBy(F.col("priority_score").desc(), "issue_class",
                                            "fact_kind")
    return out.withColumn("priority_score", total).withColumn("rank", F.row_number().over(w))


def assessment_id(groups: DataFrame) -> DataFrame:
    """Content-addressed id per capture, over its groups in display order."""
    text = F.format_string("|%s:%s:%s:%d", "issue_class", "fact_kind", "severity", "recurrence")
    row = F.struct((-F.col("severity_rank")).alias("a"), (-F.col("recurrence")).alias("b"),
                   F.col("issue_class").alias("c"), F.col("fact_kind").alias("d"), text.alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "")
    return groups.groupBy("capture_id").agg(listed.alias("_t")).select(
        "capture_id", F.substring(F.sha2(F.concat(
            F.col("capture_id"), F.lit(f"|{vocab.POSTURE_SCHEMA_VERSION}"), F.col("_t")), 256),
            1, 16).alias("assessment_id"))


def score_review(groups: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every formula over every capture.  Captures are counted in thousands, not billions, so
    the builtin exact median is enough here."""
    scored = None
    for name in FORMULAS:
        one = posture_score(groups, coverage, name).select("formula_id", "value", "band")
        scored = one if scored is None else scored.unionByName(one)
    bands = [b for _, b in vocab.BAND_CUTS] + ["CRITICAL", "INSUFFICIENT_EVIDENCE"]
    v = F.col("value")
    return scored.groupBy("formula_id").agg(
        F.count(F.lit(1)).alias("captures"), F.round(F.avg(v), 2).alias("mean"),
        F.round(F.median(v), 2).alias("median"), F.round(F.min(v), 2).alias("min"),
        F.round(F.max(v), 2).alias("max"), F.count_if(v == 0).alias("at_zero"),
        F.count_if(v == 100).alias("at_hundred"),
        F.countDistinct(F.round(v, 2)).alias("distinct_values"),
        *[F.count_if(F.col("band") == b).alias(f"band_{b.lower()}") for b in bands])


def display(value: Column) -> Column:
    return casts.number_text(value)
