"""Quality rules with robust multivariate outliers, DataFrame functions only.

Base counts of a text give a rule of its own (`base_failed`) and a vector of transformed statistics.
Over the documents that pass the rule, location and scatter of the vectors are estimated per
language and source by the minimum covariance determinant: concentration steps keep the `SHARE` of a
group's documents with the least Mahalanobis distance and estimate anew, which lowers the
determinant each time.  A document is rejected when its squared distance is above `CUT`.

A group with fewer than `LEAST` documents uses the estimate of its language, a language with fewer
that of the corpus.  A ridge keeps the scatter of statistics that hardly vary regular, and the
distances of a group are scaled so that its concentrated part has the size it has under normality
(never enlarged).  The step's quantile is read from a histogram of distances, so no group is sorted.

Defined results: null counts as a text without words; texts without words fail the base rule; null
languages and sources are groups of their own; a table in which no document passes rejects none
besides; rows that repeat are judged each; null ids pass through; an empty table gives an empty
result; columns other than text, language and source are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepost.llm import scratch

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("f1", "f2", "f3", "f4", "f5")
LEAST, SHARE, STEPS = 100, 0.75, 6
#: chi-square with five degrees of freedom: its value at SHARE, and the cut (one in 10**5)
EXPECTED, CUT = 6.626, 30.86
#: symbols and repeated lines per word at which a text of a group without any is rejected
APART = 0.1
#: least deviation of each statistic; those of f3 and f4, which clean groups do not vary, put the cut at APART
RIDGE = (0.5, 0.08, (APART / CUT) ** 0.5, (APART / CUT) ** 0.5, 0.12)
#: histogram bins per doubling of a squared distance
BINS = 32


def _windows(words: Column) -> Column:
    """Hash and place of every three-word window."""
    shifted = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"),
                           F.slice(words, 3, F.greatest(F.size(words), F.lit(1))).alias("c"))
    return F.transform(F.slice(shifted, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                       lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("p")))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, *keep)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *keep)
    one = base.withColumn("trimmed", F.btrim("text", F.lit(BLANKS))) \
        .withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BLANK))) \
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != ""))
    two = one.select(
        "doc_id", *keep, F.size("words").cast("bigint").alias("n_words"),
        F.coalesce(F.length(F.array_join("words", "")), F.lit(0)).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(_windows(F.col("words"))).alias("windows"))
    pairs = F.arrays_zip(F.col("windows").alias("x"), F.slice("windows", 2, F.greatest(F.size("windows"), F.lit(1))).alias("y"))
    equal = F.filter(F.slice(pairs, 1, F.greatest(F.size("windows") - 1, F.lit(0))), lambda z: z["x"]["h"] == z["y"]["h"])
    three = two.withColumn("equal", equal).drop("windows")
    places = F.sort_array(F.array_distinct(F.flatten(F.transform("equal", lambda z: F.array(z["x"]["p"], z["y"]["p"])))))
    four = three.withColumn("places", places).drop("equal")
    steps = F.zip_with(F.col("places"), F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    n_repeat = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x).cast("bigint")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return four.withColumn("n_repeat_words", n_repeat).drop("places").withColumn("base_failed", failed)


def vector(df: DataFrame) -> DataFrame:
    """`df` with the transformed statistics: logs of length and mean word length, roots of shares."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "f1": F.log(words), "f2": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "f3": F.sqrt(F.col("n_symbols") / words),
        "f4": F.sqrt(F.col("n_dup_lines") / words), "f5": F.sqrt(F.col("n_repeat_words") / words)})


def _moments(df: DataFrame, group: str) -> DataFrame:
    """Mean m_i and lower Cholesky factor l_i_j of the ridged covariance of each group."""
    p = len(FEATURES)
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
            *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)]]
    out = df.groupBy(group).agg(*sums)
    for i in range(p):
        for j in range(i + 1):
            cov = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(RIDGE[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-9))) if i == j else cov / F.col(f"l{j}{j}"))
    return out.select(group, "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance(df: DataFrame, state: DataFrame, group: str) -> DataFrame:
    """`df` with d, the squared Mahalanobis distance under its group's state, by forward substitution."""
    out, p = df.join(state, group), len(FEATURES)
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, p)), F.col("y0") * F.col("y0")))


def _bin(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-9))) * BINS).cast("int")


def _quantiles(distances: DataFrame, group: str) -> DataFrame:
    """(group, last): the histogram bin at which SHARE of the group's distances are reached."""
    bins = distances.select(group, _bin(F.col("d")).alias("bin")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("k"))
    every = Window.partitionBy(group)
    upto = bins.withColumn("upto", F.sum("k").over(every.orderBy("bin"))).withColumn("all", F.sum("k").over(every))
    return upto.filter(F.col("upto") >= F.col("all") * SHARE).groupBy(group).agg(F.min("bin").alias("last"))


def estimates(vectors: DataFrame, group: str, name: str) -> DataFrame:
    """MCD location, scatter and scale of each group."""
    state = scratch.keep(_moments(vectors, group), name)
    for _ in range(STEPS):
        far = _distance(vectors, state, group)
        inner = far.join(_quantiles(far, group), group).filter(_bin(F.col("d")) <= F.col("last")).select(group, *FEATURES)
        state = scratch.keep(_moments(inner, group), name)
    edge = _quantiles(_distance(vectors, state, group), group)
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("last") + 1) / BINS) / EXPECTED, F.lit(1.0))
    return scratch.keep(state.join(edge.select(group, scale.alias("scale")), group), name)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance), one row per row of `docs`."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own = vector(counts(named, "id", "text", ("lang", "source"))).withColumns(
        {"fine": F.concat(part("lang"), F.lit("\x1f"), part("source")), "middle": part("lang"), "coarse": F.lit("*")}).drop("lang", "source")
    own = scratch.keep(own, "counts")
    passed = own.filter("not base_failed")
    sizes = passed.groupBy("fine", "middle").agg(F.count(F.lit(1)).alias("n"))
    of_middle = sizes.groupBy("middle").agg(F.sum("n").alias("n_middle"))
    level = sizes.join(of_middle, "middle").select(
        "fine", F.when(F.col("n") >= LEAST, F.col("fine")).when(F.col("n_middle") >= LEAST, F.col("middle")).otherwise(F.lit("*")).alias("group"))
    level = scratch.keep(level, "level")
    joined = passed.join(level, "fine")
    wanted = level.select("group").distinct()
    members = joined.select(F.explode(F.array_distinct(F.array("fine", "middle", "coarse"))).alias("group"), *FEATURES).join(wanted, "group", "left_semi")
    state = estimates(scratch.keep(members, "vectors"), "group", "mcd")
    far = _distance(joined, state, "group").withColumn("distance", F.col("d") / F.col("scale"))
    head = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = far.select(*head, (F.col("distance") <= CUT).alias("kept"), "distance")
    return good.unionByName(own.filter("base_failed").select(*head, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
