"""URL filter by empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are shrunk through beta-binomial priors down the tree of
names: the corpus is the prior of a suffix, the suffix that of a registered domain, the domain that
of a host.  A prior leaves out the pages of the name it is for, so no page counts twice.  The strength of each prior is the method-of-moments estimate of how much rates differ
within their parents.  A page is blocked when the lower posterior bound of its host's bad rate,
mean - Z deviations, is above `LIMIT`.  Given rules come first: the longest that fits decides.

A host's suffix is its last label, or its last two where these are in `SUFFIXES`; its registered
domain is one label more; a host without a dot, and a numeric address, is its own domain.

Defined results: a null url or one without `://` has empty host and path and no rule; an unlabelled
host gets its parents' posterior; without any label nothing is blocked; pages that repeat an id are
judged each, and each counts with that id's outcome; outcomes that contradict each other for one id,
or are null, are not used; null ids have no outcome; an empty table gives an empty result; other
columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch

#: fixed values: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: fixed values: suffixes of two labels
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
LIMIT, Z = 0.5, 2.0
#: bounds of the estimated correlation within a parent
WEAKEST, STRONGEST = 0.005, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = None
    for rule, decision in sorted(rules, key=lambda r: -len(r[0])):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit("/" + own_path))
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(decision)) if verdict is None else verdict.when(fits, F.lit(decision))
    return name, verdict


def domain_columns(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port does not count."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last_two = F.substring_index(bare, ".", -2)
    double = last_two.isin(*SUFFIXES)
    alone = ~F.contains(bare, F.lit(".")) | F.regexp_like(bare, F.lit(r"^[\d.]+$"))
    domain = F.when(alone, bare).when(double, F.substring_index(bare, ".", -3)).otherwise(last_two)
    suffix = F.when(alone, F.lit("")).when(double, last_two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def strength_of(joined: DataFrame) -> float:
    """Prior strength of the rows (n, bad, above) below their parents: one number, from sums."""
    variance = F.greatest(F.col("above") * (1 - F.col("above")), F.lit(1e-9))
    spread, groups, more = joined.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), 2) / variance),
        F.count(F.lit(1)), F.sum(F.col("n") - 1)).first()
    rho = ((spread or 0.0) - groups) / max(more or 0, 1)
    return 1 / min(max(rho, WEAKEST), STRONGEST) - 1


def _below(children: DataFrame, parents: DataFrame, link: str) -> DataFrame:
    """`children` (key columns, n, bad) with above, the rate that their parent (link, n, bad, above,
    strength) expects of them from everything but their own pages, and strength, that of this prior."""
    up = parents.select(link, F.col("n").alias("n_up"), F.col("bad").alias("bad_up"), F.col("above").alias("above_up"), F.col("strength").alias("strength_up"))
    above = (F.col("strength_up") * F.col("above_up") + F.col("bad_up") - F.col("bad")) / (F.col("strength_up") + F.col("n_up") - F.col("n"))
    joined = children.join(up, link).withColumn("above", above).drop("n_up", "bad_up", "above_up", "strength_up")
    return joined.withColumn("strength", F.lit(strength_of(joined)))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, labelled, mean, deviation, bound) of every host; `outcomes` has host and bad (1, 0 or
    null), one row per page."""
    domain, suffix = domain_columns(F.col("host"))
    hosts = scratch.keep(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                         .withColumns({"domain": domain, "suffix": suffix}), "hosts")
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = suffixes.withColumn("above", (bad - F.col("bad") + 0.5) / (n - F.col("n") + 1))
    suffixes = suffixes.withColumn("strength", F.lit(strength_of(suffixes)))
    hosts = _below(hosts, _below(domains, suffixes, "suffix"), "domain")
    mean = (F.col("strength") * F.col("above") + F.col("bad")) / (F.col("strength") + F.col("n"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + F.col("n") + 1))
    bound = F.col("mean") - Z * deviation if n else F.lit(0.0)
    return hosts.withColumn("mean", mean).select("host", F.col("n").alias("labelled"), "mean", deviation.alias("deviation"), bound.alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id", label_col: str = "quality", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound), one row per row of `pages`.  `labels` has a
    page's id and whether it is good (1) or bad (0)."""
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = labels.select(F.col(label_id).alias("label_id"), F.col(label_col).alias("label")).filter("label_id is not null") \
        .groupBy("label_id").agg(F.when(F.min("label") == F.max("label"), 1 - F.max("label")).alias("bad"))
    seen = own.select("page_id", "host").join(known, F.col("page_id") == F.col("label_id"), "left")
    names = reputation(seen.select("host", "bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return own.join(names, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mean", "bound")
