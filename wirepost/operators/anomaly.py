"""Feature vectors and the unsupervised anomaly lane.

Two matrix forms are used.  Long form is (keys..., row id, column, value).  Wide form is one
`row` array per session in the order of `COLUMNS`; most of its columns are zero or one, so their
medians follow from sums and only the few numeric columns are ever exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirepost.functions import casts, vocab
from wirepost.functions import evidence as ev
from wirepost.operators import skew
from wirepost.plans.lineage import hinted, written

# ------------------------------------------------------------- fixed values: feature schema
TRI = ["true", "false", "UNKNOWN", "AMBIGUOUS", "INCOMPLETE", "NOT_OBSERVABLE", "INFERRED",
       vocab.OTHER]
#: feature -> (group, vocabulary of a categorical or None, a missing flag exists)
FEATURES = {
    "proto": ("PROTOCOL", ["smtp", "imap", "pop3", vocab.NO_PROTOCOL, vocab.OTHER], False),
    "tls_mode": ("PROTOCOL", ["explicit", "implicit"], False),
    "port_class": ("PROTOCOL", ["smtp", "submission", "smtps", "imap", "imaps", "pop3", "pop3s",
                                vocab.OTHER], False),
    "starttls_advertised": ("PROTOCOL", TRI, False),
    "starttls_requested": ("PROTOCOL", TRI, False),
    "starttls_accepted": ("PROTOCOL", TRI, False),
    "plaintext_continuation": ("PROTOCOL", TRI, False),
    "app_state": ("PROTOCOL", vocab.APP_STATES + [vocab.OTHER], False),
    "n_transitions": ("PROTOCOL", None, False),
    "n_events": ("PROTOCOL", None, False),
    "n_event_kinds": ("PROTOCOL", None, False),
    "has_greeting": ("PROTOCOL", None, False),
    "has_capability": ("PROTOCOL", None, False),
    "tls_state": ("TLS", vocab.TLS_STATES + [vocab.OTHER], False),
    "tls_version": ("TLS", ["SSL3.0", "TLS1.0", "TLS1.1", "TLS1.2", "TLS1.3", "UNKNOWN",
                            "AMBIGUOUS", "INCOMPLETE", "NOT_OBSERVABLE", vocab.OTHER], False),
    "tls_version_ordinal": ("TLS", None, True),
    "tls_cipher": ("TLS", ["0x1301", "0x1302", "0x1303", "0xc02f", "0xc030", "0xc013", "0x009c",
                           "UNKNOWN", "NOT_OBSERVABLE", "AMBIGUOUS", "INCOMPLETE", vocab.OTHER],
                   False),
    "tls_transition": ("TLS", TRI, False),
    "tls_records_present": ("TLS", None, False),
    "packet_count_log": ("STRUCTURE", None, False),
    "duration_s": ("STRUCTURE", None, True),
    "frame_span": ("STRUCTURE", None, True),
    "completeness": ("STRUCTURE", ["COMPLETE", "INCOMPLETE", "TRUNCATED", vocab.OTHER], False),
    "setup_observed": ("STRUCTURE", None, False),
    "teardown_observed": ("STRUCTURE", None, False),
    "reset_observed": ("STRUCTURE", None, False),
    "events_per_packet": ("STRUCTURE", None, True),
    "c2s_events": ("STRUCTURE", None, False),
    "s2c_events": ("STRUCTURE", None, False),
    "direction_balance": ("STRUCTURE", None, True),
    "auth_activity": ("AUTH", TRI, False),
    "auth_before_tls": ("AUTH", None, False),
    "auth_without_tls": ("AUTH", None, False),
    "comparability": ("CONTEXT", ["COMPARABLE", "NOT_COMPARABLE", "INSUFFICIENT_EVIDENCE",
                                  "AMBIGUOUS", vocab.OTHER], False),
    "baseline_status": ("CONTEXT", ["ESTABLISHED", "INSUFFICIENT_HISTORY", "NOT_APPLICABLE",
                                    vocab.OTHER], False),
    "baseline_size": ("CONTEXT", None, True),
    "baseline_upgrade_rate": ("CONTEXT", None, True),
    "upgrade_deviation": ("CONTEXT", None, True),
    "baseline_consistency": ("CONTEXT", None, True),
    "deviating_features": ("CONTEXT", None, True),
    "contrast_state": ("CONTEXT", ["CONTRAST_SUPPORTED", "CONTRAST_INSUFFICIENT",
                                   "CONTRAST_NOT_APPLICABLE", "CONTRAST_AMBIGUOUS", vocab.OTHER],
                       False),
    "control_count": ("CONTEXT", None, True),
    "control_upgrade_rate": ("CONTEXT", None, True),
    "contrast_gap": ("CONTEXT", None, True),
}
VERSION_ORDINAL = {"SSL3.0": 1.0, "TLS1.0": 2.0, "TLS1.1": 3.0, "TLS1.2": 4.0, "TLS1.3": 5.0}
MAD_TO_SIGMA = 1.4826
NOVELTY = 3.0
MIN_SCALE = 1e-6
BORDERLINE_MARGIN = 0.15
# --------------------------------------------------------------------- end of fixed values
GROUPS = ["PROTOCOL", "TLS", "STRUCTURE", "AUTH", "CONTEXT"]
FLAGS = ["has_greeting", "has_capability", "tls_records_present", "setup_observed",
         "teardown_observed", "reset_observed", "auth_before_tls", "auth_without_tls"]


def layout(groups=None, exclude=()) -> list[tuple[str, str, str | None]]:
    """(column, feature, category) in schema order; a numeric column has no category and its
    missing flag the category `__missing`."""
    out = []
    for fid in sorted(FEATURES):
        group, words, missing = FEATURES[fid]
        if (groups and group not in groups) or fid in exclude:
            continue
        if words is not None:
            out += [(f"{fid}={w}", fid, w) for w in words]
        else:
            out.append((fid, fid, None))
            if missing:
                out.append((f"{fid}__missing", fid, "__missing"))
    return out


COLUMNS = [c for c, _, _ in layout()]
NUMERIC = [c for c, f, w in layout() if w is None and f not in FLAGS]


# ------------------------------------------------------------------------------- features
def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def feat_protocol() -> dict[str, Column]:
    tri = ["starttls_advertised", "starttls_requested", "starttls_accepted", "plaintext_continuation"]
    return {
        "proto": F.coalesce("protocol", F.lit(vocab.NO_PROTOCOL)),
        "tls_mode": F.when(F.col("implicit_tls"), "implicit").otherwise("explicit"),
        "port_class": casts.port_class(F.col("server_port")),
        **{f: ev.tri_state(f) for f in tri},
        "app_state": F.col("app_state"),
        **{c: F.col(c).cast("double") for c in ("n_transitions", "n_events", "n_event_kinds")},
        "has_greeting": _flag(F.col("has_greeting")), "has_capability": _flag(F.col("has_capability"))}


def feat_tls() -> dict[str, Column]:
    version = ev.reading("tls_negotiated_version")
    ordinal = F.lit(None).cast("double")
    for name, place in VERSION_ORDINAL.items():
        ordinal = F.when(version == name, F.lit(place)).otherwise(ordinal)
    return {
        "tls_state": F.col("tls_state"), "tls_version": version, "tls_version_ordinal": ordinal,
        "tls_cipher": F.coalesce(F.lower("tls_cipher_suite.value"), F.col("tls_cipher_suite.state")),
        "tls_transition": ev.tri_state("tls_transition"),
        "tls_records_present": _flag(F.col("tls_state") != "NONE")}


def feat_structure() -> dict[str, Column]:
    c2s, s2c, packets = (F.col(c).cast("double") for c in ("c2s_events", "s2c_events", "packet_count"))
    return {
        "packet_count_log": F.log1p(F.greatest(packets, F.lit(0.0))),
        "duration_s": F.col("end_epoch") - F.col("start_epoch"),
        "frame_span": (F.col("last_frame") - F.col("first_frame")).cast("double"),
        "completeness": F.col("completeness"), "setup_observed": _flag(F.col("setup")),
        "teardown_observed": _flag(F.col("teardown")), "reset_observed": _flag(F.col("reset")),
        "events_per_packet": F.when(packets > 0, F.col("n_events") / packets),
        "c2s_events": c2s, "s2c_events": s2c,
        "direction_balance": F.when(c2s + s2c > 0, (c2s - s2c) / (c2s + s2c))}


def feat_auth() -> dict[str, Column]:
    up = F.col("tls_state") == "ESTABLISHED"
    decided = F.col("auth_activity.state").isin("OBSERVED", "INFERRED") & (F.col("auth_activity.value") == "true")
    return {"auth_activity": ev.tri_state("auth_activity"),
            "auth_before_tls": _flag(F.col("first_auth_frame") < F.col("first_tls_frame")),
            "auth_without_tls": _flag(decided & ~up)}


def feat_context() -> dict[str, Column]:
    """Needs `cross.cross_context(..., dominant=True)` columns."""
    from wirepost.operators import cross
    usable = F.col("baseline_status") == "ESTABLISHED"
    up = (F.col("tls_state") == "ESTABLISHED").cast("double")
    consistent = sum((F.col(f"expected_{f}").isNotNull().cast("double") for f in cross.FEATURES), F.lit(0.0))
    deviating = sum((F.coalesce(F.col(f"dominant_{f}") != F.col(f"feature_{f}"), F.lit(False)).cast("double")
                     for f in cross.FEATURES), F.lit(0.0))
    return {
        "comparability": F.col("comparability"), "baseline_status": F.col("baseline_status"),
        "baseline_size": F.col("prior_count").cast("double"),
        "baseline_upgrade_rate": F.col("baseline_rate"),
        "upgrade_deviation": F.abs(up - F.col("baseline_rate")),
        "baseline_consistency": F.when(usable, consistent / len(cross.FEATURES)),
        "deviating_features": F.when(usable, deviating),
        "contrast_state": F.col("contrast_state"), "control_count": F.col("control_count").cast("double"),
        "control_upgrade_rate": F.col("control_rate"), "contrast_gap": F.col("control_rate") - up}


EXTRACTORS: dict[str, Callable[[], dict[str, Column]]] = {
    "PROTOCOL": feat_protocol, "TLS": feat_tls, "STRUCTURE": feat_structure, "AUTH": feat_auth,
    "CONTEXT": feat_context}
ID = ["capture_id", "stream_key"]


def features(sessions: DataFrame, groups=None, keep=()) -> DataFrame:
    """One column per feature; a missing numeric is null until it is encoded."""
    cols = {k: c for g in (groups or GROUPS) for k, c in EXTRACTORS[g]().items()}
    return sessions.select(*ID, *keep, *[c.alias(f"f_{k}") for k, c in cols.items()])


def encoded_column(fid: str, word: str | None) -> str:
    """SQL text of one encoded column."""
    c = f"`f_{fid}`"
    if word is None:
        return f"coalesce(CAST({c} AS DOUBLE), 0D)"
    if word == "__missing":
        return f"CAST({c} IS NULL AS DOUBLE)"
    words = FEATURES[fid][1]
    if word == vocab.OTHER:
        known = ", ".join(f"'{w}'" for w in words if w != vocab.OTHER)
        return f"CAST(NOT coalesce({c} IN ({known}), false) AS DOUBLE)"
    return f"CAST(coalesce({c} = '{word}', false) AS DOUBLE)"


def encode(feats: DataFrame, groups=None, exclude=(), keep=()) -> DataFrame:
    """Fixed-layout numeric row; an unseen category goes to `__other__`."""
    cols = ", ".join(encoded_column(f, w) for _, f, w in layout(groups, exclude))
    return feats.select(*ID, *keep, F.expr(f"array({cols})").alias("row"))


def layout_signature(groups=None, exclude=()) -> Column:
    text = "\n".join(c for c, _, _ in layout(groups, exclude))
    return F.substring(F.sha2(F.lit(text), 256), 1, 16)


def row_text(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda v: F.format_string("%.6f", v)), ",")


def row_hash(row: Column) -> Column:
    """Short display id of a row; groups and joins use the whole hash."""
    return F.substring(F.sha2(row_text(row), 256), 1, 16)


def dataset_hash(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free identity of a matrix: the rows' hashes are added as four integers of 64 bits each
    (twice 32, in decimals that do not overflow), so nothing is collected or sorted."""
    h = F.sha2(row_text(F.col("row")), 256)
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = matrix.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)])
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(8)])
    return sums.select(*keys, F.substring(F.sha2(text, 256), 1, 16).alias("dataset_hash"), "rows")


# -------------------------------------------------------------------- long-form models
def fit_robust(long: DataFrame, keys: list[str]) -> DataFrame:
    """Median and scaled MAD of each column; a column without spread is marked constant.  The rows are
    read once: deviations are counted from the counts of the values."""
    by = [*keys, "column"]
    counts = written(skew.value_counts(long, by, "value"))
    med = skew.counted_median(counts, by, "value", "med").drop("n")
    away = skew.join_few(counts, med, by, "value").withColumn("_d", F.abs(F.col("value") - F.col("med"))) \
        .groupBy(*by, "_d").agg(F.sum("_c").alias("_c"))
    mad = skew.counted_median(away, by, "_d", "mad").drop("n")
    scale = F.col("mad") * MAD_TO_SIGMA
    return med.join(mad, by).select(*by, "med", F.greatest(scale, F.lit(MIN_SCALE)).alias("scale"),
                                    (scale < MIN_SCALE).alias("constant"))


def z_score(value: str = "value") -> Column:
    v = F.col(value)
    return F.when(F.col("constant"), F.when(v == F.col("med"), 0.0).otherwise(NOVELTY)).otherwise((v - F.col("med")) / F.col("scale"))


def with_z(long: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return long.join(stats, [*keys, "column"]).withColumn("z", z_score())


def score_robust(long: DataFrame, stats: DataFrame, keys: list[str], row: str) -> DataFrame:
    return with_z(long, stats, keys).groupBy(*keys, row).agg(F.sum(F.abs("z")).alias("score"))


def score_topk(long: DataFrame, stats: DataFrame, keys: list[str], row: str, k: int) -> DataFrame:
    w = W.partitionBy(*keys, row).orderBy(F.abs("z").desc(), "column")
    top = with_z(long, stats, keys).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*keys, row).agg(F.avg(F.abs("z")).alias("score"))


def contributions(long: DataFrame, stats: DataFrame, keys: list[str], row: str, k: int = 5) -> DataFrame:
    """The columns a row's score rests on most; ties go to the earlier column."""
    z = F.col("z")
    w = W.partitionBy(*keys, row).orderBy(F.abs("z").desc(), "column")
    kept = with_z(long, stats, keys).filter(F.abs("z") >= 1e-9).withColumn("place", F.row_number().over(w))
    return kept.filter(F.col("place") <= k).select(
        *keys, row, "place", "column", F.abs("z").alias("contribution"),
        F.when(F.col("constant"), "differs_from_normal").when(z > 0, "above_normal")
         .otherwise("below_normal").alias("direction"))


def fit_mean(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "column").agg(F.avg("value").alias("mean"))


def score_mean(long: DataFrame, means: DataFrame, keys: list[str], row: str) -> DataFrame:
    d = F.col("value") - F.col("mean")
    return long.join(means, [*keys, "column"]).groupBy(*keys, row).agg(F.sqrt(F.sum(d * d)).alias("score"))


def occlusion(long: DataFrame, means: DataFrame, reference: DataFrame, keys: list[str], row: str,
              k: int = 5) -> DataFrame:
    """How much the mean-distance score drops when one column is reset to the typical row.

    The reset score has a closed form in the squared distance, so nothing is scored again.
    """
    d, r = F.col("value") - F.col("mean"), F.col("reference") - F.col("mean")
    each = W.partitionBy(*keys, row)
    joined = long.join(means, [*keys, "column"]).join(reference, [*keys, "column"]) \
        .withColumns({"_d2": d * d, "_r2": r * r}).withColumn("_s", F.sum("_d2").over(each))
    away = F.abs(F.col("value") - F.col("reference"))
    near = joined.filter(F.col("value") != F.col("reference")).withColumn(
        "_p", F.row_number().over(each.orderBy(away.desc(), "column")))
    delta = F.sqrt("_s") - F.sqrt(F.greatest(F.col("_s") - F.col("_d2") + F.col("_r2"), F.lit(0.0)))
    raised = near.withColumn("delta", delta).filter(F.col("delta") > 0)
    return raised.withColumn("place", F.row_number().over(each.orderBy(F.col("delta").desc(), "_p"))) \
        .filter(F.col("place") <= k).select(
            *keys, row, "place", "column", "delta",
            F.when(F.col("value") > F.col("reference"), "above_normal").otherwise("below_normal").alias("direction"))


def occlusion_robust(long: DataFrame, stats: DataFrame, reference: DataFrame, keys: list[str], row: str, k: int = 5,
                     top: int | None = None) -> DataFrame:
    """How much a robust score drops when one column is reset to the typical row.

    Of the sum of all terms the drop is the difference of the two terms.  Of the mean of the `top`
    largest, only a column among them can lower it: the next term, or its own reset one if that is
    larger, moves up into its place.  So each row is ranked once and nothing is scored again.  Drops
    of less than 1e-9 are rounding and left out; equal drops go to the column that moved furthest.
    """
    each = W.partitionBy(*keys, row)
    term, reset, away = F.col("_t"), F.col("_r"), F.abs(F.col("value") - F.col("reference"))
    terms = with_z(long, stats, keys).join(reference, [*keys, "column"]) \
        .withColumns({"_t": F.abs("z"), "_r": F.abs(z_score("reference"))})
    if top is None:
        delta = term - reset
    else:
        terms = terms.withColumn("_at", F.row_number().over(each.orderBy(term.desc(), "column"))).withColumns({
            "_next": F.max(F.when(F.col("_at") == top + 1, term)).over(each), "_n": F.least(F.lit(top), F.max("_at").over(each))})
        delta = F.when(F.col("_at") <= top, (term - F.greatest(reset, F.coalesce("_next", F.lit(0.0)))) / F.col("_n"))
    raised = terms.withColumn("delta", delta).filter((F.col("value") != F.col("reference")) & (F.col("delta") > 1e-9))
    return raised.withColumn("place", F.row_number().over(each.orderBy(F.col("delta").desc(), away.desc(), "column"))) \
        .filter(F.col("place") <= k).select(
            *keys, row, "place", "column", "delta",
            F.when(F.col("value") > F.col("reference"), "above_normal").otherwise("below_normal").alias("direction"))


def threshold(scores: DataFrame, keys: list[str], quantile: float) -> DataFrame:
    """Nearest-rank quantile: always a score that occurred."""
    rank = F.bround(F.lit(quantile) * (F.col("n") - 1)).cast("bigint") + 1
    counts = written(skew.value_counts(scores, keys, "score"))
    return skew.counted_values_at(counts, keys, "score", {"threshold": rank}).drop("n")


def band(margin: float = BORDERLINE_MARGIN) -> Column:
    s, t = F.col("score"), F.col("threshold")
    return (F.when(s.isNull(), "NOT_SCORED").when(t.isNull(), "BORDERLINE").when(s >= t, "ANOMALOUS")
            .when(s >= t - F.abs(t) * margin, "BORDERLINE").otherwise("NORMAL"))


def abstain_reason() -> Column:
    return F.when(F.col("protocol").isNull(), "no mail protocol") \
        .when(F.col("completeness").isin("TRUNCATED", "INCOMPLETE"),
              F.concat(F.lit("completeness is "), F.col("completeness")))


# ------------------------------------------------------------------------------ the lane
def fit_wide(matrix: DataFrame, groups=None, exclude=()) -> DataFrame:
    """Per capture, an array of (median, scale, constant) in column order.

    A zero-one column's median follows from its sum: its MAD is zero unless exactly half of the
    rows are one.  Numeric columns go through exact order statistics.
    """
    cols = layout(groups, exclude)
    numeric = [(i, c) for i, (c, f, w) in enumerate(cols) if w is None and f not in FLAGS]
    binary = [i for i in range(len(cols)) if i not in {j for j, _ in numeric}]
    sums = matrix.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("_n"), F.expr("array(" + ", ".join(f"sum(row[{i}])" for i in binary) + ")").alias("_ones"))
    pairs = ", ".join(f"named_struct('column', {i}, 'value', row[{i}])" for i, _ in numeric)
    long = matrix.select("capture_id", F.expr(f"inline(array({pairs}))"))
    fitted = fit_robust(long, ["capture_id"]).groupBy("capture_id").agg(F.map_from_entries(F.collect_list(
        F.struct("column", F.struct("med", "scale", "constant")))).alias("_num"))
    spot = {i: k for k, i in enumerate(binary)}
    half = {"med": 0.5, "scale": 0.5 * MAD_TO_SIGMA}

    def one(i: int) -> str:
        if i not in spot:
            return f"_num[{i}]"
        ones = f"_ones[{spot[i]}] * 2"
        return (f"named_struct('med', CASE WHEN {ones} < _n THEN 0D WHEN {ones} > _n THEN 1D ELSE {half['med']}D END, "
                f"'scale', CASE WHEN {ones} = _n THEN {half['scale']}D ELSE {MIN_SCALE:.6f}D END, 'constant', {ones} <> _n)")
    stats = F.expr("array(" + ", ".join(one(i) for i in range(len(cols))) + ")")
    return sums.join(fitted, "capture_id", "left").select("capture_id", stats.alias("stats"))


@dataclass(frozen=True)
class Model:
    """What a lane needs of a model: `fit` turns the matrix (capture_id, row) into one `stats` per
    capture, `terms` gives the signed deviation of each column of `row` under `stats`, and `score`
    the total of such terms."""
    name: str
    basis: str
    fit: Callable[[DataFrame], DataFrame]
    terms: Callable[[], Column]
    score: Callable[[Column], Column]


def _robust_terms() -> Column:
    return F.expr(f"""zip_with(row, stats, (v, t) -> CASE WHEN t.constant THEN CASE WHEN v = t.med THEN 0D ELSE {NOVELTY}D END
                      ELSE (v - t.med) / t.scale END)""")


def robust_model(groups=None, exclude=()) -> Model:
    return Model("robust-z", "median and scaled deviation of the capture's own sessions", lambda m: fit_wide(m, groups, exclude),
                 _robust_terms, lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.abs(x)))


def _fit_means(matrix: DataFrame) -> DataFrame:
    long = matrix.select("capture_id", F.posexplode("row").alias("column", "value"))
    means = long.groupBy("capture_id", "column").agg(F.avg("value").alias("mean"))
    return means.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "mean"))), lambda c: c["mean"]).alias("stats"))


MEAN_MODEL = Model("mean-distance", "mean of the capture's own sessions", _fit_means, lambda: F.zip_with("row", "stats", lambda v, m: v - m),
                   lambda terms: F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x * x)))


def _top_terms(names: list[str], k: int) -> Column:
    """The columns a score rests on most; ties go to the earlier column."""
    placed = F.transform("_terms", lambda t, i: F.struct((-F.abs(t)).alias("least"), i.alias("at"), t.alias("term")))
    first = F.slice(F.sort_array(F.filter(placed, lambda p: p["least"] < -1e-9)), 1, k)
    known = F.array(*[F.lit(n) for n in names])
    return F.transform(first, lambda p: F.struct(
        F.get(known, p["at"]).alias("column"), (-p["least"]).alias("contribution"),
        F.when(p["term"] > 0, "above_normal").otherwise("below_normal").alias("direction")))


def anomaly_lane(context: DataFrame, quantile: float = 0.95, groups=None, exclude=(), model: Model | None = None,
                 judge_truncated: bool = False, top: int = 5) -> DataFrame:
    """Fit, threshold, score and explain every capture on its own sessions.

    All sessions take part in the fit and the threshold; those that must not be judged come out
    as NOT_SCORED (`judge_truncated` opts truncated and incomplete ones in).  A result names its top
    columns, the model and its basis, the layout and a hash of the fitted statistics.
    """
    if not 0.0 < quantile < 1.0:
        raise ValueError(f"quantile {quantile} is not between 0 and 1")
    model = model or robust_model(groups, exclude)
    feats = features(context, groups, keep=("protocol", "completeness"))
    # the matrix feeds every column statistic, the scores and the result: compute it once
    matrix = written(encode(feats, groups, exclude, keep=("protocol", "completeness")))
    stats = hinted(written(model.fit(matrix)).withColumn("artifact_hash", F.sha2(F.to_json(F.struct("stats"), {"ignoreNullFields": "false"}), 256)))
    names = [c for c, _, _ in layout(groups, exclude)]
    scored = matrix.join(stats, "capture_id").withColumn("_terms", model.terms()) \
        .withColumns({"score": model.score(F.col("_terms")), "top_features": _top_terms(names, top)}).drop("row", "stats", "_terms")
    limits = hinted(written(threshold(scored, ["capture_id"], quantile)))
    reason = F.when(F.col("protocol").isNull(), "no mail protocol") if judge_truncated else abstain_reason()
    return (scored.join(limits, "capture_id", "left")
            .withColumns({"reason": reason, "model": F.lit(model.name), "basis": F.lit(model.basis), "layout": layout_signature(groups, exclude)})
            .withColumn("score", F.when(F.col("reason").isNull(), F.col("score")))
            .withColumn("top_features", F.when(F.col("reason").isNull(), F.col("top_features")))
            .withColumn("band", band()).drop("protocol", "completeness"))


def lane_report(results: DataFrame) -> DataFrame:
    kinds = ["ANOMALOUS", "BORDERLINE", "NORMAL", "NOT_SCORED"]
    return results.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("sessions_seen"), F.count("score").alias("sessions_scored"),
        F.count_if(F.col("score").isNull()).alias("abstentions"), F.max("threshold").alias("threshold"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in kinds])
