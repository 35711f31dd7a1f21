"""Downgrade detectors over session observations: single-session, pooled and time-aware.

Observations carry: session_id, protocol, client, server, day, advertised, commanded, tls_ok,
plaintext, truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = {
    "global": [], "server": ["server"], "client": ["client"], "pair": ["client", "server"],
    "pair+proto": ["client", "server", "protocol"], "server+proto": ["server", "protocol"],
}
DIMS = ["client", "server", "protocol"]


def detector_d1(obs: DataFrame) -> DataFrame:
    """Advertised but never upgraded is suspect; a truncated session is not judged."""
    return obs.withColumn("verdict", F.when(F.col("truncated"), "UNKNOWN")
                          .when(F.col("advertised") & ~F.col("tls_ok"), "SUSPECT_DOWNGRADE")
                          .otherwise("BENIGN"))


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if("advertised").alias("advertised"),
            F.count_if("commanded").alias("commanded"), F.count_if("tls_ok").alias("tls_ok"),
            F.count_if("plaintext").alias("plaintext"),
            F.count_if(F.col("commanded") & ~F.col("tls_ok")).alias("failed"),
            F.count_if("truncated").alias("truncated")]


def population_stats(obs: DataFrame) -> DataFrame:
    """Counts for all six keys.  The observations are counted once at the finest grain; the
    grouping sets then run over those few rows."""
    fine = obs.groupBy(*DIMS).agg(*_measures())
    sets = [[F.col(c) for c in cols] for cols in KEYS.values()]
    sums = [F.sum(c).alias(c) for c in
            ("n", "advertised", "commanded", "tls_ok", "plaintext", "failed", "truncated")]
    gid = F.grouping_id(*[F.col(c) for c in DIMS])
    names = {0b111: "global", 0b101: "server", 0b011: "client", 0b001: "pair", 0b000: "pair+proto",
             0b100: "server+proto"}
    level = None
    for bits, name in names.items():
        level = F.when(gid == bits, name) if level is None else level.when(gid == bits, name)
    return fine.groupingSets(sets, *[F.col(c) for c in DIMS]).agg(level.alias("key"), *sums)


def infra_state(stats: DataFrame, min_history: int = 5) -> DataFrame:
    usable = F.col("n") - F.col("truncated")
    return stats.withColumn("state", F.when(usable < min_history, "INSUFFICIENT_HISTORY")
                            .when(F.col("tls_ok") == 0, "CONSISTENT_PLAINTEXT")
                            .when(F.col("tls_ok") == usable, "CONSISTENT_TLS").otherwise("MIXED"))


def detector_d2(obs: DataFrame, key: str = "pair+proto", contrast: bool = False,
                min_history: int = 5) -> DataFrame:
    """Judge a session by the behaviour of its population; with `contrast`, an always-plaintext
    population turns suspect when its server upgrades for anybody."""
    cols = KEYS[key] or ["_all"]
    base = obs.withColumn("_all", F.lit(1))
    own = infra_state(base.groupBy(*cols).agg(*_measures()), min_history) \
        .select(*cols, "state")
    joined = base.join(own, cols)
    if contrast:
        server = base.groupBy("server", "protocol").agg(F.count_if("tls_ok").alias("_server_up"))
        joined = joined.join(server, ["server", "protocol"])
    else:
        joined = joined.withColumn("_server_up", F.lit(0))
    s = F.col("state")
    verdict = (F.when(F.col("truncated"), "UNKNOWN").when(F.col("tls_ok"), "BENIGN")
               .when(s == "INSUFFICIENT_HISTORY", "INSUFFICIENT_HISTORY")
               .when((s == "CONSISTENT_PLAINTEXT") & (F.col("_server_up") == 0), "BENIGN")
               .otherwise("SUSPECT_DOWNGRADE"))
    return joined.withColumn("verdict", verdict).drop("_all", "_server_up")


def detector_time(obs: DataFrame, min_history: int = 5) -> DataFrame:
    """History from earlier days only; a day's own sessions never vouch for each other."""
    daily = obs.groupBy(*DIMS, "day").agg(
        F.count_if(~F.col("truncated")).alias("_n"),
        F.count_if(~F.col("truncated") & F.col("tls_ok")).alias("_up"))
    earlier = W.partitionBy(*DIMS).orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    prior = daily.select(*DIMS, "day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("prior_n"),
                         F.coalesce(F.sum("_up").over(earlier), F.lit(0)).alias("prior_up"))
    verdict = (F.when(F.col("truncated"), "UNKNOWN").when(F.col("tls_ok"), "BENIGN")
               .when(F.col("prior_n") < min_history, "INSUFFICIENT_HISTORY")
               .when(F.col("prior_up") == 0, "BENIGN").otherwise("SUSPECT_DOWNGRADE"))
    return obs.join(prior, DIMS + ["day"]).withColumn("verdict", verdict)


def endpoint_rates(obs: DataFrame) -> DataFrame:
    kept = obs.filter(~F.col("truncated"))
    return kept.groupBy(*DIMS).agg(F.count(F.lit(1)).alias("sessions"),
                                   F.count_if("tls_ok").alias("upgraded")) \
        .withColumn("rate", F.round(F.col("upgraded") / F.col("sessions"), 4))
