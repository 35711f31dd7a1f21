"""Queries that judge detectors and models against labels.

Records carry: model, split, row_id, score, attack, blind, scenario, capture, generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepost.operators import anomaly, skew


def make_splits(records: DataFrame, heldout: list[str], validation: list[str]) -> DataFrame:
    """Assign generators and scenarios to splits; records no split takes are dropped."""
    g, s, benign = F.col("generator"), F.col("scenario"), ~F.col("attack")
    split = (F.when((g == "B") & s.isin(heldout), "TEST_B").when((g == "B") & benign, "TRAIN")
             .when((g == "C") & ~s.isin(validation), "TEST_C").when((g == "C") & benign, "VAL")
             .when(g == "A", "TEST_A"))
    return records.withColumn("split", split).filter(F.col("split").isNotNull())


def leakage_report(records: DataFrame) -> DataFrame:
    """Rows, scenarios and captures that a split shares with TRAIN."""
    train = records.filter(F.col("split") == "TRAIN")
    hashes = train.select("row_hash").distinct().withColumn("_seen", F.lit(True))
    rows = records.join(hashes, "row_hash", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("total_rows"), F.countDistinct("row_hash").alias("distinct_rows"),
        F.count("_seen").alias("rows_in_train"))

    def shared(cols: list[str], name: str) -> DataFrame:
        pairs = records.select("split", *cols).distinct()
        return pairs.join(train.select(*cols).distinct(), cols, "left_semi").groupBy("split") \
            .agg(F.count(F.lit(1)).alias(name))
    out = rows.join(shared(["scenario"], "shared_scenarios"), "split", "left") \
        .join(shared(["generator", "capture"], "shared_captures"), "split", "left")
    return out.filter(F.col("split") != "TRAIN").fillna(0)


def train_overlap(records: DataFrame) -> DataFrame:
    """Scenarios that occur both in TRAIN and in another split."""
    train = F.col("split") == "TRAIN"
    return records.filter(train).select("scenario").intersect(records.filter(~train).select("scenario"))


def inventory(records: DataFrame) -> DataFrame:
    return records.groupBy("generator").agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("capture").alias("captures"),
        F.countDistinct("scenario").alias("scenarios"), F.count_if("attack").alias("attacks"),
        F.count_if(~F.col("attack")).alias("benign"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def derived(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return df.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4),
                           "fpr": F.round(_ratio(fp, fp + tn), 4)})


def confusion(df: DataFrame, keys: list[str], flagged: str = "flagged", abstained: str | None = None) -> DataFrame:
    """Confusion counts; an abstention on an attack is a miss, on a benign session neither."""
    f, y = F.col(flagged), F.col("attack")
    out = F.col(abstained) if abstained else F.lit(False)
    counts = df.groupBy(*keys).agg(
        F.count_if(~out & f & y).alias("tp"), F.count_if(~out & f & ~y).alias("fp"),
        F.count_if(y & (out | ~f)).alias("fn"), F.count_if(~out & ~f & ~y).alias("tn"),
        F.count_if(out).alias("abstained"))
    return derived(counts)


def ranking_metrics(df: DataFrame, keys: list[str], width: float = 0.001) -> DataFrame:
    """Exact average precision and ROC area per key.

    Equal scores are counted first; running totals over the distinct scores, cut into score
    ranges of `width`, give both areas.  One class only leaves them null.
    """
    s = F.col("score")
    points = df.groupBy(*keys, "score").agg(F.count_if("attack").alias("pos"), F.count_if(~F.col("attack")).alias("neg")) \
        .withColumn("_block", F.floor(-s / width))
    order = [s.desc()]
    run = skew.running_total(points, keys, "_block", order, F.col("pos"), "tp")
    run = skew.running_total(run, keys, "_block", order, F.col("neg"), "fp")
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    both = run.join(totals, keys)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    below = F.col("N") - F.col("fp") + F.col("neg") / 2
    areas = both.groupBy(*keys).agg(
        F.max("P").alias("P"), F.max("N").alias("N"), F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(F.col("pos") * below).alias("_roc"))
    defined = (F.col("P") > 0) & (F.col("N") > 0)
    return areas.select(*keys, F.when(defined, F.round(F.col("_ap") / F.col("P"), 4)).alias("pr_auc"),
                        F.when(defined, F.round(F.col("_roc") / (F.col("P") * F.col("N")), 4)).alias("roc_auc"),
                        F.round(F.col("P") / (F.col("P") + F.col("N")), 4).alias("positive_rate"))


def thresholds(validation: DataFrame, quantiles: list[float]) -> DataFrame:
    """One threshold per model and false-positive budget, from validation scores."""
    ranks = {f"q{i}": F.bround(F.lit(q) * (F.col("n") - 1)).cast("bigint") + 1 for i, q in enumerate(quantiles)}
    wide = skew.values_at(validation, ["model"], "score", ranks)
    entries = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("threshold"))
                        for i, q in enumerate(quantiles)])
    return wide.select("model", F.inline(entries))


def sweep(scores: DataFrame, cuts: DataFrame) -> DataFrame:
    """Confusion of every model, split and budget.  Whether the few cuts travel to
    the scores is left to the size that the join sees."""
    flagged = scores.join(cuts, "model").withColumn("flagged", F.col("score") >= F.col("threshold"))
    return confusion(flagged, ["model", "split", "quantile"])


def stability(runs: DataFrame, metric: str) -> DataFrame:
    m = F.col(metric)
    return runs.groupBy("model").agg(
        F.round(F.min(m), 4).alias("min"), F.round(F.max(m), 4).alias("max"), F.round(F.avg(m), 4).alias("mean"),
        F.round(F.max(m) - F.min(m), 4).alias("range"))


def overlap(rule_flags: DataFrame, model_flags: DataFrame) -> DataFrame:
    """Two systems over one population: what each flags alone, and the attacks in each part.

    `rule_flags` has key, rules, cross, attack, blind; `model_flags` has key, ml.
    """
    both = rule_flags.join(model_flags, "key", "full_outer")
    det = F.coalesce(F.col("rules") | F.col("cross"), F.lit(False))
    ml = F.coalesce("ml", F.lit(False))
    y = F.coalesce("attack", F.lit(False))
    return both.agg(
        F.count_if(det & ~ml).alias("deterministic_only"), F.count_if(ml & ~det).alias("ml_only"),
        F.count_if(det & ml).alias("both"), F.count_if(ml & ~det & y).alias("ml_only_attacks"),
        F.count_if(ml & ~det & ~y).alias("ml_only_benign"), F.count_if(det & ~ml & y).alias("deterministic_only_attacks"),
        F.count_if(y & ~det & ~ml).alias("missed_by_both"),
        F.count_if(y & ~det & ~ml & ~F.coalesce("blind", F.lit(False))).alias("sighted_missed_by_both"))


def system_confusion(flags: DataFrame) -> DataFrame:
    """The five systems of the comparison, each as a confusion row."""
    r, c, m = F.col("rules"), F.col("cross"), F.col("ml")
    systems = {"A_deterministic": r, "B_cross_session": c, "C_ml_only": m, "D_deterministic_plus_ml": r | m,
               "E_cross_session_plus_ml": c | m}
    long = flags.select("attack", F.inline(F.array(*[
        F.struct(F.lit(n).alias("system"), f.alias("flagged")) for n, f in systems.items()])))
    return confusion(long, ["system"])


def select_model(swept: DataFrame, ranking: DataFrame, quantile: float, max_flag_rate: float = 0.10) -> DataFrame:
    """Models that flag little enough on every split, ranked by PR area; the best is chosen."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    gate = swept.filter(F.col("quantile") == quantile).groupBy("model").agg(
        F.bool_and((F.col("tp") + F.col("fp")) / F.greatest(n, F.lit(1)) <= max_flag_rate).alias("eligible"))
    from pyspark.sql import Window as W
    place = F.row_number().over(W.partitionBy("eligible").orderBy(F.coalesce("pr_auc", F.lit(-1.0)).desc(), "model"))
    return gate.join(ranking.select("model", "pr_auc"), "model").withColumn("place", place) \
        .withColumn("chosen", F.col("eligible") & (F.col("place") == 1))


def jaccard(flags: DataFrame, keys: list[str]) -> DataFrame:
    a, b = F.col("ml"), F.col("rules")
    return flags.groupBy(*keys).agg(
        F.count_if(a).alias("ml_flagged"), F.count_if(b).alias("rules_flagged"),
        F.round(_ratio(F.count_if(a & b), F.count_if(a | b)), 4).alias("jaccard"),
        F.count_if(a & ~b).alias("ml_only"), F.count_if(a & ~b & F.col("attack")).alias("ml_only_attacks"))


def benign_fp(df: DataFrame, cut: float) -> DataFrame:
    """False-positive rate and median score of the benign sessions of each scenario."""
    benign = df.filter(~F.col("attack"))
    rates = benign.groupBy("scenario").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("score") >= cut).alias("flagged"))
    mid = skew.median(benign, ["scenario"], "score", "median_score").drop("n")
    return rates.join(mid, "scenario").select(
        "scenario", "sessions", "flagged", F.round(F.col("flagged") / F.col("sessions"), 4).alias("fp_rate"),
        F.round("median_score", 4).alias("median_score"))


def ablation(long: DataFrame, subsets: dict, keys: list[str], row: str) -> DataFrame:
    """Total deviation per row for each subset of columns, from one fitted matrix: the column
    statistics do not depend on the subset, so the matrix is fitted and joined once.  A subset is a
    list of columns, a condition on the column, or None for all."""
    z = anomaly.with_z(long, anomaly.fit_robust(long, keys), keys)
    def member(cols):
        return F.lit(True) if cols is None else cols(F.col("column")) if callable(cols) else F.col("column").isin(list(cols))
    sums = [F.sum(F.when(member(cols), F.abs("z")).otherwise(0.0)).alias(name) for name, cols in subsets.items()]
    wide = z.groupBy(*keys, row).agg(*sums)
    entries = F.array(*[F.struct(F.lit(n).alias("subset"), F.col(n).alias("score")) for n in subsets])
    return wide.select(*keys, row, F.inline(entries))


def group_subsets() -> dict[str, list[str]]:
    """The features of every group alone, of all but each group, of all, and of all but the cipher."""
    group = {f: spec[0] for f, spec in anomaly.FEATURES.items()}
    out = {"all": list(group), "without_tls_cipher": [f for f in group if f != "tls_cipher"]}
    for g in anomaly.GROUPS:
        out[f"only_{g.lower()}"] = [f for f in group if group[f] == g]
        out[f"without_{g.lower()}"] = [f for f in group if group[f] != g]
    return out


def group_ablation(matrix: DataFrame, subsets: dict[str, list[str]] | None = None, quantile: float = 0.95) -> DataFrame:
    """Which feature groups carry the signal: threshold, confusion and ranking areas per subset.

    `matrix` has capture_id, row (all features encoded), split, attack and blind.  Each capture is
    fitted once on its split TRAIN: a column's statistics do not depend on the others, so a subset is a
    mask over the deviations and all subsets are scored in one pass.  The threshold is the nearest-rank
    quantile of VALIDATION; the other splits are judged by it.  The areas leave blind sessions out.
    Scores are rounded to six decimals, so that sessions of equal deviations tie.  Without training or
    validation rows a capture has no result.
    """
    subsets = group_subsets() if subsets is None else subsets
    features = [f for _, f, _ in anomaly.layout()]
    unknown = {f for fids in subsets.values() for f in fids} - set(features)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    model = anomaly.robust_model()
    stats = anomaly.written(model.fit(matrix.filter(F.col("split") == "TRAIN")))
    terms = matrix.filter(F.col("split") != "TRAIN").join(stats, "capture_id").withColumn("_terms", model.terms())

    def total(fids):
        mask = F.array(*[F.lit(1.0 if f in set(fids) else 0.0) for f in features])
        return F.round(F.aggregate(F.zip_with("_terms", mask, lambda t, m: F.abs(t) * m), F.lit(0.0), lambda a, x: a + x), 6)

    scores = F.array(*[F.struct(F.lit(n).alias("subset"), total(fids).alias("score")) for n, fids in subsets.items()])
    long = anomaly.written(terms.select("capture_id", "split", "attack", "blind", F.inline(scores)))
    key = ["capture_id", "subset"]
    limits = anomaly.threshold(long.filter(F.col("split") == "VALIDATION"), key, quantile)
    tests = long.filter(F.col("split") != "VALIDATION")
    judged = confusion(tests.join(limits, key).withColumn("flagged", F.col("score") >= F.col("threshold")), [*key, "split"])
    areas = ranking_metrics(tests.filter(~F.col("blind")), [*key, "split"], width=1.0).drop("positive_rate")
    seen = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    widths = F.create_map(*[F.lit(v) for n, fids in subsets.items() for v in (n, sum(f in set(fids) for f in features))])
    return judged.drop("abstained").join(limits, key).join(areas, [*key, "split"], "left").withColumns({
        "columns": widths[F.col("subset")], "flag_rate": F.round((F.col("tp") + F.col("fp")) / seen, 4)})


def feature_variance(df: DataFrame) -> DataFrame:
    """Distinct key exchanges, forward-secrecy outcomes and certificate visibility per corpus."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return df.groupBy("corpus").agg(joined("kex").alias("kex"), joined("forward_secret").alias("forward_secret"),
                                    joined("x509_present").alias("x509_present"))


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our view of a capture against the dissector's: ours has sessions, advertised, versions;
    theirs has capability_frames, server_hellos."""
    both = ours.join(theirs, "capture", "full_outer").fillna(
        {"sessions": 0, "versions": 0, "capability_frames": 0, "server_hellos": 0})
    wire, we = F.col("capability_frames") > 0, F.coalesce("advertised", F.lit(False))
    blind = (F.col("server_hellos") > 0) & (F.col("versions") == 0)
    kind = (F.when(F.col("sessions") == 0, "infrastructure").when(blind | (wire & ~we), "parser-bug")
            .when(we & ~wire, "wrong-security-claim").otherwise("agreed"))
    return both.withColumn("classification", kind) \
        .withColumn("result", F.when(F.col("classification") == "agreed", "PASS").otherwise("FAIL"))


def separability(matrix: DataFrame, label: str, folds: int = 5, trees: int = 200, seed: int = 42) -> DataFrame:
    """Can a forest tell the label from the features?  Cross-validated accuracy against the
    majority rate."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = matrix.select(array_to_vector("row").alias("features"), F.col(label).cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    model = CrossValidator(estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge,
                           numFolds=folds, seed=seed).fit(data)
    accuracy = float(model.avgMetrics[0])
    top = max(enumerate(model.bestModel.featureImportances.toArray()), key=lambda p: p[1])[0]
    counts = data.groupBy("label").count()
    return counts.agg((F.max("count") / F.sum("count")).alias("majority_rate")).select(
        F.round(F.lit(accuracy), 4).alias("accuracy"), F.round("majority_rate", 4).alias("majority_rate"),
        (F.lit(accuracy) > F.col("majority_rate") + 0.05).alias("separable"), F.lit(int(top)).alias("top_column"))
