"""Feature vectors, the anomaly lane and the evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import cross_queries, lifts
from queries.base import S, query
from queries.cross_queries import CONTEXT, OBS
from wirepost.functions import vocab
from wirepost.operators import anomaly, cross, detectors, evaluation, skew

_TRIX = "CASE WHEN {p}_state IN ('OBSERVED', 'INFERRED') AND {p}_value IN ('true', 'false') THEN {p}_value ELSE {p}_state END"
_PC = "CASE server_port " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in vocab.PORT_CLASSES.items()) + f" ELSE '{vocab.OTHER}' END"
_UP = "CASE WHEN tls_state = 'ESTABLISHED' THEN 1.0 ELSE 0.0 END"
_D = "CAST({x} AS DOUBLE)"
FEATURE_SQL = {
    "proto": f"coalesce(protocol, '{vocab.NO_PROTOCOL}')", "tls_mode": "CASE WHEN implicit_tls THEN 'implicit' ELSE 'explicit' END", "port_class": _PC,
    "starttls_advertised": _TRIX.format(p="adv"), "starttls_requested": _TRIX.format(p="req"), "starttls_accepted": _TRIX.format(p="acc"),
    "plaintext_continuation": _TRIX.format(p="pc"), "app_state": "app_state", "n_transitions": "n_transitions", "n_events": "n_events", "n_event_kinds": "n_event_kinds",
    "has_greeting": "CAST(has_greeting AS INT)", "has_capability": "CAST(has_capability AS INT)", "tls_state": "tls_state", "tls_version": "coalesce(ver_value, ver_state)",
    "tls_version_ordinal": "CASE ver_value WHEN 'SSL3.0' THEN 1 WHEN 'TLS1.0' THEN 2 WHEN 'TLS1.1' THEN 3 WHEN 'TLS1.2' THEN 4 WHEN 'TLS1.3' THEN 5 END",
    "tls_cipher": "coalesce(lower(cip_value), cip_state)", "tls_transition": _TRIX.format(p="tt"), "tls_records_present": "CASE WHEN tls_state <> 'NONE' THEN 1 ELSE 0 END",
    "packet_count_log": "ln(1 + packet_count)", "duration_s": "end_epoch - start_epoch", "frame_span": "last_frame - first_frame", "completeness": "completeness",
    "setup_observed": "CAST(setup AS INT)", "teardown_observed": "CAST(teardown AS INT)", "reset_observed": "CAST(reset AS INT)",
    "events_per_packet": "CASE WHEN packet_count > 0 THEN n_events / CAST(packet_count AS DOUBLE) END", "c2s_events": "c2s_events", "s2c_events": "s2c_events",
    "direction_balance": "CASE WHEN c2s_events + s2c_events > 0 THEN (c2s_events - s2c_events) / CAST(c2s_events + s2c_events AS DOUBLE) END",
    "auth_activity": _TRIX.format(p="auth"), "auth_before_tls": "CAST(coalesce(first_auth_frame < first_tls_frame, false) AS INT)",
    "auth_without_tls": "CAST(coalesce(auth_value = 'true', false) AND tls_state <> 'ESTABLISHED' AS INT)",
    "comparability": "comparability", "baseline_status": "baseline_status", "baseline_size": "prior_count",
    "baseline_upgrade_rate": "CASE WHEN usable THEN ups / CAST(prior_count AS DOUBLE) END",
    "upgrade_deviation": f"CASE WHEN usable THEN abs({_UP} - ups / CAST(prior_count AS DOUBLE)) END",
    "baseline_consistency": "CASE WHEN usable THEN ncons / 5.0 END", "deviating_features": "CASE WHEN usable THEN ndev END", "contrast_state": "contrast_state",
    "control_count": "control_count", "control_upgrade_rate": "control_rate", "contrast_gap": f"control_rate - {_UP}",
}
_FEATS = "(VALUES ('adv'), ('req'), ('est'), ('ver'), ('auth')) q(feature)"
_VAL = "CASE feature WHEN 'adv' THEN {t}.f_adv WHEN 'req' THEN {t}.f_req WHEN 'est' THEN {t}.f_est WHEN 'ver' THEN {t}.f_ver ELSE {t}.f_auth END"
FT = f"""{CONTEXT}, hl AS (SELECT x.stream_key, feature, {_VAL.format(t='x')} AS own, {_VAL.format(t='y')} AS value, count(*) AS n
    FROM h x JOIN h y ON x.capture_id = y.capture_id AND x.client_ip = y.client_ip AND x.server_ip = y.server_ip AND x.server_port = y.server_port
      AND x.protocol = y.protocol AND x.implicit_tls = y.implicit_tls AND y.rn BETWEEN x.rn - 50 AND x.rn - 1 CROSS JOIN {_FEATS} GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY stream_key, feature ORDER BY n DESC, value) AS rk, count(*) OVER (PARTITION BY stream_key, feature) AS nv FROM hl),
hd AS (SELECT stream_key, count(CASE WHEN nv = 1 THEN 1 END) AS ncons, count(CASE WHEN own <> value THEN 1 END) AS ndev FROM hr WHERE rk = 1 GROUP BY 1),
ft AS (SELECT ctx.capture_id, ctx.stream_key, ctx.protocol AS the_protocol, ctx.completeness AS the_completeness, {', '.join(f"{e if anomaly.FEATURES[k][1] else _D.format(x=e)} AS f_{k}" for k, e in FEATURE_SQL.items())}
  FROM ctx LEFT JOIN hd ON hd.stream_key = ctx.stream_key)"""


def _enc(fid, word):
    c = f"f_{fid}"
    if word is None:
        return f"coalesce({c}, 0.0)"
    if word == "__missing":
        return f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END"
    if word == vocab.OTHER:
        known = ", ".join(f"'{w}'" for w in anomaly.FEATURES[fid][1] if w != vocab.OTHER)
        return f"CASE WHEN {c} IN ({known}) THEN 0.0 ELSE 1.0 END"
    return f"CASE WHEN {c} = '{word}' THEN 1.0 ELSE 0.0 END"


def mx(groups=None, exclude=(), name="mx"):
    cols = ", ".join(f"CAST({_enc(f, w)} AS DOUBLE)" for _, f, w in anomaly.layout(groups, exclude))
    return f"{name} AS (SELECT capture_id, stream_key, the_protocol, the_completeness, [{cols}] AS r FROM ft)"


MX = mx()
LANE = f"""{MX}, lg AS (SELECT capture_id, stream_key, unnest(range(1, len(r) + 1)) AS c, unnest(r) AS v FROM mx),
md AS (SELECT capture_id, c, median(v) AS m FROM lg GROUP BY 1, 2), ma AS (SELECT lg.capture_id, lg.c, any_value(m) AS m, median(abs(v - m)) * 1.4826 AS sc FROM lg JOIN md ON lg.capture_id = md.capture_id AND lg.c = md.c GROUP BY 1, 2),
scr AS (SELECT lg.capture_id, stream_key, sum(CASE WHEN sc < 0.000001 THEN CASE WHEN v = m THEN 0.0 ELSE 3.0 END ELSE abs(v - m) / sc END) AS score FROM lg JOIN ma ON lg.capture_id = ma.capture_id AND lg.c = ma.c GROUP BY 1, 2),
th0 AS (SELECT capture_id, score, row_number() OVER (PARTITION BY capture_id ORDER BY score) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM scr),
th AS (SELECT capture_id, score AS threshold FROM th0 WHERE rn = round_even(0.95 * (n - 1), 0) + 1),
an AS (SELECT scr.capture_id, scr.stream_key, threshold, CASE WHEN the_protocol IS NOT NULL AND the_completeness = 'COMPLETE' THEN score END AS score FROM scr JOIN th USING (capture_id) JOIN mx ON mx.stream_key = scr.stream_key),
ab AS (SELECT *, CASE WHEN score IS NULL THEN 'NOT_SCORED' WHEN score >= threshold - 0.0000001 THEN 'ANOMALOUS' WHEN score >= threshold - abs(threshold) * 0.15 THEN 'BORDERLINE' ELSE 'NORMAL' END AS band FROM an)"""


def context(spark, sf):
    return cross.cross_context(lifts.sessions(spark, sf), dominant=True)


def _round(col, numeric):
    return F.round(col, 4) if numeric else col


def _feature_query(name, group):
    fids = [f for f, (g, _, _) in anomaly.FEATURES.items() if g == group]
    cols = ", ".join(f"round(f_{f}, 4) AS {f}" if anomaly.FEATURES[f][1] is None else f"f_{f} AS {f}" for f in fids)

    @query(name, f"WITH {S}, {FT} SELECT stream_key, {cols} FROM ft")
    def run(spark, sf):
        s = context(spark, sf) if group == "CONTEXT" else lifts.sessions(spark, sf)
        return anomaly.features(s, [group]).select(
            "stream_key", *[_round(F.col(f"f_{f}"), anomaly.FEATURES[f][1] is None).alias(f) for f in fids])


for _n, _g in (("feat_protocol", "PROTOCOL"), ("feat_tls", "TLS"), ("feat_structure", "STRUCTURE"), ("feat_auth", "AUTH"), ("feat_context", "CONTEXT")):
    _feature_query(_n, _g)


@query("encode", f"""WITH {S}, {FT}, {MX} SELECT stream_key, len(r) AS width, list_sum(r[1:60]) AS part1, round(list_sum(r), 4) AS total,
  round(list_sum(list_transform(r, lambda v, i: v * i)), 3) AS weighted FROM mx""")
def encode(spark, sf):
    m = anomaly.encode(anomaly.features(context(spark, sf)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return m.select("stream_key", F.size("row").alias("width"), add(F.slice("row", 1, 60)).alias("part1"),
                    F.round(add(F.col("row")), 4).alias("total"),
                    F.round(add(F.transform("row", lambda v, i: v * (i + 1))), 3).alias("weighted"))


_SIG = "||chr(10)||".join("'" + c + "'" for c in anomaly.COLUMNS)


@query("layout_signature", f"""WITH {S}, {FT}, {MX}, cells AS (SELECT capture_id, stream_key, unnest(range(1, len(r) + 1)) AS c, unnest(r) AS v FROM mx)
  SELECT capture_id, substr(sha256({_SIG}), 1, 16) AS layout_signature, count(DISTINCT stream_key) AS sessions, count(DISTINCT c) AS width, count(DISTINCT CASE WHEN v <> 0 THEN c END) AS columns_in_use FROM cells GROUP BY 1""")
def layout_signature(spark, sf):
    """The layout beside what the encoded matrix of each capture holds of it."""
    m = anomaly.encode(anomaly.features(context(spark, sf)))
    used = m.select("capture_id", F.posexplode("row").alias("c", "v")).groupBy("capture_id", "c") \
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("v") != 0).alias("used"))
    return used.groupBy("capture_id").agg(F.max("n").alias("sessions"), F.count(F.lit(1)).alias("width"), F.count_if("used").alias("columns_in_use")) \
        .withColumn("layout_signature", anomaly.layout_signature())


# long matrix of the embedding table
_LONG = "CASE vec_id % 3 WHEN 0 THEN 'g0' WHEN 1 THEN 'g1' ELSE 'g2' END"
L6 = f"""e AS (SELECT {_LONG} AS grp, vec_id, unnest(range(0, len(embedding))) AS "column", round(CAST(unnest(embedding) AS DOUBLE), 4) AS value FROM embeddings)"""
FIT = f"""{L6}, md AS (SELECT grp, "column", median(value) AS med FROM e GROUP BY 1, 2),
st AS (SELECT e.grp, e."column", any_value(med) AS med, greatest(median(abs(value - med)) * 1.4826, 0.000001) AS scale, median(abs(value - med)) * 1.4826 < 0.000001 AS constant
  FROM e JOIN md ON e.grp = md.grp AND e."column" = md."column" GROUP BY 1, 2)"""
Z = f"""{FIT}, z AS (SELECT e.*, constant, CASE WHEN constant THEN CASE WHEN value = med THEN 0.0 ELSE 3.0 END ELSE (value - med) / scale END AS z
  FROM e JOIN st ON e.grp = st.grp AND e."column" = st."column")"""


def matrix(spark, sf):
    lifts.register(spark, sf, "embeddings")
    e = spark.table("embeddings")
    return e.select(F.expr(_LONG).alias("grp"), "vec_id", F.posexplode("embedding").alias("column", "v")) \
        .select("grp", "vec_id", "column", F.round(F.col("v").cast("double"), 4).alias("value"))


_HASHED = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("dataset_hash", f"""WITH {L6}, rw AS (SELECT grp, vec_id, sha256(string_agg(printf('%.6f', value + 0.0), ',' ORDER BY "column")) AS h FROM e GROUP BY 1, 2)
  SELECT grp, substr(sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_HASHED})), 1, 16) AS dataset_hash, count(*) AS rows FROM rw GROUP BY 1""")
def dataset_hash(spark, sf):
    lifts.register(spark, sf, "embeddings")
    rows = spark.table("embeddings").select(
        F.expr(_LONG).alias("grp"), F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("row"))
    return anomaly.dataset_hash(rows, ["grp"])


@query("fit_robust", f'WITH {FIT} SELECT grp, "column", round(med, 6) AS med, round(scale, 6) AS scale, constant FROM st')
def fit_robust(spark, sf):
    return anomaly.fit_robust(matrix(spark, sf), ["grp"]).select(
        "grp", "column", F.round("med", 6).alias("med"), F.round("scale", 6).alias("scale"), "constant")


def _fitted(spark, sf):
    m = matrix(spark, sf)
    return m, anomaly.fit_robust(m, ["grp"])


@query("score_robust", f"WITH {Z} SELECT grp, vec_id, round(sum(abs(z)), 4) AS score FROM z GROUP BY 1, 2")
def score_robust(spark, sf):
    m, s = _fitted(spark, sf)
    return anomaly.score_robust(m, s, ["grp"], "vec_id").withColumn("score", F.round("score", 4))


def _topk(k):
    @query(f"score_topk_{k}", f"""WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id ORDER BY abs(z) DESC, "column") AS rk FROM z)
      SELECT grp, vec_id, round(avg(abs(z)), 4) AS score FROM r WHERE rk <= {k} GROUP BY 1, 2""")
    def run(spark, sf):
        m, s = _fitted(spark, sf)
        return anomaly.score_topk(m, s, ["grp"], "vec_id", k).withColumn("score", F.round("score", 4))


for _k in (3, 5, 10):
    _topk(_k)


@query("contributions", f"""WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id ORDER BY abs(z) DESC, "column") AS place FROM z WHERE abs(z) >= 1e-9)
  SELECT grp, vec_id, place, "column", round(abs(z), 4) AS contribution, CASE WHEN constant THEN 'differs_from_normal' WHEN z > 0 THEN 'above_normal' ELSE 'below_normal' END AS direction FROM r WHERE place <= 5""")
def contributions(spark, sf):
    m, s = _fitted(spark, sf)
    return anomaly.contributions(m, s, ["grp"], "vec_id").withColumn("contribution", F.round("contribution", 4))


MEAN = f'{L6}, mn AS (SELECT grp, "column", avg(value) AS mean FROM e GROUP BY 1, 2)'


@query("fit_mean", f'WITH {MEAN} SELECT grp, "column", round(mean, 6) AS mean FROM mn')
def fit_mean(spark, sf):
    return anomaly.fit_mean(matrix(spark, sf), ["grp"]).withColumn("mean", F.round("mean", 6))


@query("score_mean", f'WITH {MEAN} SELECT e.grp, vec_id, round(sqrt(sum(pow(value - mean, 2))), 4) AS score FROM e JOIN mn ON e.grp = mn.grp AND e."column" = mn."column" GROUP BY 1, 2')
def score_mean(spark, sf):
    m = matrix(spark, sf)
    return anomaly.score_mean(m, anomaly.fit_mean(m, ["grp"]), ["grp"], "vec_id").withColumn("score", F.round("score", 4))


@query("reference_row", f'WITH {FIT} SELECT grp, "column", round(med, 6) AS reference FROM st')
def reference_row(spark, sf):
    return skew.median(matrix(spark, sf), ["grp", "column"], "value", "reference").drop("n") \
        .withColumn("reference", F.round("reference", 6))


@query("occlusion", f"""WITH {FIT}, mn AS (SELECT grp, "column", avg(value) AS mean FROM e GROUP BY 1, 2),
  j AS (SELECT e.*, med AS ref, pow(value - mean, 2) AS d2, pow(med - mean, 2) AS r2, sum(pow(value - mean, 2)) OVER (PARTITION BY e.grp, vec_id) AS s FROM e
    JOIN mn ON e.grp = mn.grp AND e."column" = mn."column" JOIN st ON e.grp = st.grp AND e."column" = st."column"),
  p AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id ORDER BY abs(value - ref) DESC, "column") AS pr FROM j WHERE value <> ref),
  d AS (SELECT *, sqrt(s) - sqrt(greatest(s - d2 + r2, 0)) AS delta FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id ORDER BY delta DESC, pr) AS place FROM d WHERE delta > 0)
  SELECT grp, vec_id, place, "column", round(delta, 6) AS delta, CASE WHEN value > ref THEN 'above_normal' ELSE 'below_normal' END AS direction FROM k WHERE place <= 5""")
def occlusion(spark, sf):
    m = matrix(spark, sf)
    ref = skew.median(m, ["grp", "column"], "value", "reference").drop("n")
    return anomaly.occlusion(m, anomaly.fit_mean(m, ["grp"]), ref, ["grp"], "vec_id").withColumn("delta", F.round("delta", 6))


def _occlusion_robust(name, top):
    """The SQL scores every probe anew: all terms of the row, one of them reset."""
    scored = "sum(term)" if top is None else f"avg(CASE WHEN rk <= {top} THEN term END)"

    @query(name, f"""WITH {Z}, t AS (SELECT z.grp, vec_id, z."column" AS c, value, med, abs(z) AS t, 0.0 AS r FROM z JOIN st ON z.grp = st.grp AND z."column" = st."column"),
      probes AS (SELECT x.grp, x.vec_id, x.c, CASE WHEN y.c = x.c THEN x.r ELSE y.t END AS term FROM t x JOIN t y ON x.grp = y.grp AND x.vec_id = y.vec_id
        UNION ALL SELECT grp, vec_id, -1, t FROM t),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id, c ORDER BY term DESC) AS rk FROM probes), scored AS (SELECT grp, vec_id, c, {scored} AS score FROM ranked GROUP BY 1, 2, 3),
      d AS (SELECT t.*, b.score - p.score AS delta FROM t JOIN scored b ON t.grp = b.grp AND t.vec_id = b.vec_id AND b.c = -1 JOIN scored p ON t.grp = p.grp AND t.vec_id = p.vec_id AND p.c = t.c),
      k AS (SELECT *, row_number() OVER (PARTITION BY grp, vec_id ORDER BY delta DESC, abs(value - med) DESC, c) AS place FROM d WHERE value <> med AND delta > 1e-9)
      SELECT grp, vec_id, place, c AS "column", round(delta, 5) AS delta, CASE WHEN value > med THEN 'above_normal' ELSE 'below_normal' END AS direction FROM k WHERE place <= 5""")
    def run(spark, sf):
        m, s = _fitted(spark, sf)
        reference = s.select("grp", "column", F.col("med").alias("reference"))
        return anomaly.occlusion_robust(m, s, reference, ["grp"], "vec_id", top=top).withColumn("delta", F.round("delta", 5))


_occlusion_robust("occlusion_sum", None)
_occlusion_robust("occlusion_topk_5", 5)


@query("ablation", f"""WITH {Z} SELECT grp, vec_id, 'first_half' AS subset, round(sum(CASE WHEN "column" < 32 THEN abs(z) ELSE 0 END), 4) AS score FROM z GROUP BY 1, 2
  UNION ALL SELECT grp, vec_id, 'all', round(sum(abs(z)), 4) FROM z GROUP BY 1, 2
  UNION ALL SELECT grp, vec_id, 'without_first_eight', round(sum(CASE WHEN "column" >= 8 THEN abs(z) ELSE 0 END), 4) FROM z GROUP BY 1, 2""")
def ablation(spark, sf):
    subsets = {"first_half": lambda c: c < 32, "all": None, "without_first_eight": lambda c: c >= 8}
    return evaluation.ablation(matrix(spark, sf), subsets, ["grp"], "vec_id").withColumn("score", F.round("score", 4))


# records: five models score every vector
REC = """r AS (SELECT 'm' || CAST(i AS VARCHAR) AS model, vec_id AS row_id, round(CAST(embedding[i] AS DOUBLE), 3) AS score, label = 0 AS attack, vec_id % 7 = 5 AS blind,
  's' || CAST(vec_id % 7 AS VARCHAR) AS scenario, 'k' || CAST(vec_id % 20 AS VARCHAR) AS capture, CASE vec_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'A' END AS generator,
  sha256(CAST(CAST(floor(embedding[1] * 100) AS INT) AS VARCHAR)) AS row_hash FROM embeddings, (VALUES (1), (2), (3), (4), (5)) q(i))"""
HELD, VAL = ["s1", "s5"], ["s0", "s2", "s3"]
SPLIT = f"""{REC}, sp AS (SELECT *, CASE WHEN generator = 'B' AND scenario IN ('s1', 's5') THEN 'TEST_B' WHEN generator = 'B' AND NOT attack THEN 'TRAIN'
    WHEN generator = 'C' AND scenario NOT IN ('s0', 's2', 's3') THEN 'TEST_C' WHEN generator = 'C' AND NOT attack THEN 'VAL' WHEN generator = 'A' THEN 'TEST_A' END AS split FROM r),
p AS (SELECT * FROM sp WHERE split IS NOT NULL)"""


def records(spark, sf):
    lifts.register(spark, sf, "embeddings")
    v, n = F.col("embedding"), F.col("vec_id")
    one = F.inline(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(
        F.concat(F.lit("m"), i.cast("string")).alias("model"), F.round(F.get(v, i - 1).cast("double"), 3).alias("score"))))
    return spark.table("embeddings").select(
        n.alias("row_id"), (F.col("label") == 0).alias("attack"), (n % 7 == 5).alias("blind"),
        F.concat(F.lit("s"), (n % 7).cast("string")).alias("scenario"), F.concat(F.lit("k"), (n % 20).cast("string")).alias("capture"),
        F.when(n % 3 == 0, "B").when(n % 3 == 1, "C").otherwise("A").alias("generator"),
        F.sha2(F.floor(F.get(v, F.lit(0)) * 100).cast("int").cast("string"), 256).alias("row_hash"), one)


def split(spark, sf):
    return evaluation.make_splits(records(spark, sf), HELD, VAL)


@query("make_splits", f"WITH {SPLIT} SELECT model, row_id, split FROM p")
def make_splits(spark, sf):
    return split(spark, sf).select("model", "row_id", "split")


@query("leakage_report", f"""WITH {SPLIT}, t AS (SELECT * FROM p WHERE split = 'TRAIN') SELECT split, count(*) AS total_rows, count(DISTINCT row_hash) AS distinct_rows,
    count(CASE WHEN row_hash IN (SELECT row_hash FROM t) THEN 1 END) AS rows_in_train, count(DISTINCT CASE WHEN scenario IN (SELECT scenario FROM t) THEN scenario END) AS shared_scenarios,
    count(DISTINCT CASE WHEN generator || capture IN (SELECT generator || capture FROM t) THEN generator || capture END) AS shared_captures FROM p WHERE split <> 'TRAIN' GROUP BY 1""")
def leakage_report(spark, sf):
    return evaluation.leakage_report(split(spark, sf))


@query("train_overlap", f"WITH {SPLIT} SELECT scenario FROM p WHERE split = 'TRAIN' INTERSECT SELECT scenario FROM p WHERE split <> 'TRAIN'")
def train_overlap(spark, sf):
    return evaluation.train_overlap(split(spark, sf))


@query("inventory", f"""WITH {REC} SELECT generator, count(*) AS sessions, count(DISTINCT capture) AS captures, count(DISTINCT scenario) AS scenarios,
  count(CASE WHEN attack THEN 1 END) AS attacks, count(CASE WHEN NOT attack THEN 1 END) AS benign FROM r GROUP BY 1""")
def inventory(spark, sf):
    return evaluation.inventory(records(spark, sf))


DERIVED = """round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0 END, 4) AS fpr"""


def counts(flag, out="false"):
    return f"""count(CASE WHEN NOT ({out}) AND {flag} AND attack THEN 1 END) AS tp, count(CASE WHEN NOT ({out}) AND {flag} AND NOT attack THEN 1 END) AS fp,
  count(CASE WHEN attack AND (({out}) OR NOT {flag}) THEN 1 END) AS fn, count(CASE WHEN NOT ({out}) AND NOT {flag} AND NOT attack THEN 1 END) AS tn, count(CASE WHEN {out} THEN 1 END) AS abstained"""


@query("confusion", f"""WITH {OBS}, v AS (SELECT *, CASE WHEN truncated THEN 'UNKNOWN' WHEN advertised AND NOT tls_ok THEN 'SUSPECT' ELSE 'BENIGN' END AS vd FROM o),
  c AS (SELECT protocol, {counts("vd = 'SUSPECT'", "vd = 'UNKNOWN'")} FROM v GROUP BY 1) SELECT *, {DERIVED} FROM c""")
def confusion(spark, sf):
    v = detectors.detector_d1(cross_queries.observations(spark, sf))
    return evaluation.confusion(v.withColumns({"flagged": F.col("verdict") == "SUSPECT_DOWNGRADE", "out": F.col("verdict") == "UNKNOWN"}),
                                ["protocol"], abstained="out")


RANKING = """pt AS (SELECT model, split, score, count(CASE WHEN attack THEN 1 END) AS pos, count(CASE WHEN NOT attack THEN 1 END) AS neg FROM p GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, split) AS P, sum(neg) OVER (PARTITION BY model, split) AS N FROM pt WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
rk AS (SELECT model, split, CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(P), 4) END AS pr_auc,
  CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum(pos * (N - fp + neg / 2.0)) / (max(P) * max(N)), 4) END AS roc_auc, round(max(P) / CAST(max(P) + max(N) AS DOUBLE), 4) AS positive_rate FROM cu GROUP BY 1, 2)"""


@query("ranking_metrics", f"WITH {SPLIT}, {RANKING} SELECT * FROM rk")
def ranking_metrics(spark, sf):
    return evaluation.ranking_metrics(split(spark, sf), ["model", "split"])


@query("ranking_metrics_sighted", f"WITH {SPLIT.replace('WHERE split IS NOT NULL', 'WHERE split IS NOT NULL AND NOT blind')}, {RANKING} SELECT * FROM rk")
def ranking_metrics_sighted(spark, sf):
    return evaluation.ranking_metrics(split(spark, sf).filter(~F.col("blind")), ["model", "split"])


QS = [0.90, 0.95, 0.98, 0.99]
CUTS = f"""vs AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) AS rn, count(*) OVER (PARTITION BY model) AS n FROM p WHERE split = 'VAL'),
ct AS (SELECT model, q AS quantile, max(CASE WHEN rn = round_even(q * (n - 1), 0) + 1 THEN score END) AS threshold FROM vs, (VALUES (0.90::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE), (0.99::DOUBLE)) z(q) GROUP BY 1, 2),
sw AS (SELECT p.model, split, quantile, {counts('score >= threshold')} FROM p JOIN ct ON p.model = ct.model GROUP BY 1, 2, 3)"""


def cuts(spark, sf):
    return evaluation.thresholds(split(spark, sf).filter(F.col("split") == "VAL"), QS)


@query("threshold", f"WITH {SPLIT}, {CUTS} SELECT model, quantile, threshold FROM ct")
def threshold(spark, sf):
    return cuts(spark, sf)


@query("band", f"""WITH {SPLIT}, {CUTS} SELECT p.model, row_id, CASE WHEN score >= threshold THEN 'ANOMALOUS' WHEN score >= threshold - abs(threshold) * 0.15 THEN 'BORDERLINE' ELSE 'NORMAL' END AS band
  FROM p JOIN ct ON p.model = ct.model AND quantile = 0.95""")
def band(spark, sf):
    c = cuts(spark, sf).filter(F.col("quantile") == 0.95).select("model", "threshold")
    return split(spark, sf).join(c, "model").select("model", "row_id", anomaly.band().alias("band"))


@query("sweep", f"WITH {SPLIT}, {CUTS} SELECT *, {DERIVED} FROM sw")
def sweep(spark, sf):
    return evaluation.sweep(split(spark, sf), cuts(spark, sf))


@query("stability", f"""WITH {SPLIT}, {CUTS}, d AS (SELECT *, {DERIVED} FROM sw)
  SELECT model, round(min(recall), 4) AS min, round(max(recall), 4) AS max, round(avg(recall), 4) AS mean, round(max(recall) - min(recall), 4) AS range FROM d GROUP BY 1""")
def stability(spark, sf):
    return evaluation.stability(evaluation.sweep(split(spark, sf), cuts(spark, sf)), "recall")


@query("select_model", f"""WITH {SPLIT}, {CUTS}, {RANKING}, g AS (SELECT model, bool_and((tp + fp) / CAST(greatest(tp + fp + fn + tn, 1) AS DOUBLE) <= 0.10) AS eligible FROM sw WHERE quantile = 0.98 GROUP BY 1),
  f AS (SELECT g.model, eligible, pr_auc, row_number() OVER (PARTITION BY eligible ORDER BY coalesce(pr_auc, -1) DESC, g.model) AS place FROM g JOIN rk ON g.model = rk.model AND split = 'TEST_B')
  SELECT *, eligible AND place = 1 AS chosen FROM f""")
def select_model(spark, sf):
    p = split(spark, sf)
    rk = evaluation.ranking_metrics(p, ["model", "split"]).filter(F.col("split") == "TEST_B")
    return evaluation.select_model(evaluation.sweep(p, cuts(spark, sf)), rk, 0.98)


_RF = "SELECT doc_id AS key, quality = 1 AS rules, toxic = 1 AS cross, doc_id % 5 = 0 AS attack, doc_id % 7 = 0 AS blind FROM labels"
_MF = "SELECT vec_id AS key, label % 2 = 0 AS ml FROM embeddings"
FLAGS = f"rf AS ({_RF.replace('cross,', 'crs,')}), mf AS ({_MF}), fl AS (SELECT key, coalesce(rules OR crs, false) AS det, coalesce(ml, false) AS ml, coalesce(attack, false) AS attack, coalesce(blind, false) AS blind FROM rf FULL JOIN mf USING (key))"


def flag_tables(spark, sf):
    lifts.register(spark, sf, "labels", "embeddings")
    lab = spark.table("labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("rules"), (F.col("toxic") == 1).alias("cross"),
                                       (F.col("doc_id") % 5 == 0).alias("attack"), (F.col("doc_id") % 7 == 0).alias("blind"))
    return lab, spark.table("embeddings").select(F.col("vec_id").alias("key"), (F.col("label") % 2 == 0).alias("ml"))


@query("overlap", f"""WITH {FLAGS} SELECT count(CASE WHEN det AND NOT ml THEN 1 END) AS deterministic_only, count(CASE WHEN ml AND NOT det THEN 1 END) AS ml_only, count(CASE WHEN det AND ml THEN 1 END) AS both,
  count(CASE WHEN ml AND NOT det AND attack THEN 1 END) AS ml_only_attacks, count(CASE WHEN ml AND NOT det AND NOT attack THEN 1 END) AS ml_only_benign, count(CASE WHEN det AND NOT ml AND attack THEN 1 END) AS deterministic_only_attacks,
  count(CASE WHEN attack AND NOT det AND NOT ml THEN 1 END) AS missed_by_both, count(CASE WHEN attack AND NOT det AND NOT ml AND NOT blind THEN 1 END) AS sighted_missed_by_both FROM fl""")
def overlap(spark, sf):
    return evaluation.overlap(*flag_tables(spark, sf))


_SYS = " UNION ALL ".join(f"SELECT '{n}' AS system, attack, {e} AS fg FROM j" for n, e in {
    "A_deterministic": "rules", "B_cross_session": "crs", "C_ml_only": "ml", "D_deterministic_plus_ml": "rules OR ml", "E_cross_session_plus_ml": "crs OR ml"}.items())


@query("system_confusion", f"WITH {FLAGS}, j AS (SELECT * FROM rf JOIN mf USING (key)), y AS ({_SYS}), c AS (SELECT system, {counts('fg')} FROM y GROUP BY 1) SELECT *, {DERIVED} FROM c")
def system_confusion(spark, sf):
    a, b = flag_tables(spark, sf)
    return evaluation.system_confusion(a.join(b, "key"))


@query("jaccard", f"""WITH {FLAGS}, j AS (SELECT *, key % 3 AS part FROM rf JOIN mf USING (key)) SELECT part, count(CASE WHEN ml THEN 1 END) AS ml_flagged, count(CASE WHEN rules THEN 1 END) AS rules_flagged,
  round(count(CASE WHEN ml AND rules THEN 1 END) / CAST(greatest(count(CASE WHEN ml OR rules THEN 1 END), 1) AS DOUBLE), 4) AS jaccard, count(CASE WHEN ml AND NOT rules THEN 1 END) AS ml_only,
  count(CASE WHEN ml AND NOT rules AND attack THEN 1 END) AS ml_only_attacks FROM j GROUP BY 1""")
def jaccard(spark, sf):
    a, b = flag_tables(spark, sf)
    return evaluation.jaccard(a.join(b, "key").withColumn("part", F.col("key") % 3), ["part"])


@query("benign_fp", f"""WITH {REC} SELECT scenario, count(*) AS sessions, count(CASE WHEN score >= 0.1 THEN 1 END) AS flagged, round(count(CASE WHEN score >= 0.1 THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS fp_rate,
  round(median(score), 4) AS median_score FROM r WHERE NOT attack GROUP BY 1""")
def benign_fp(spark, sf):
    return evaluation.benign_fp(records(spark, sf), 0.1)


@query("feature_variance", f"""WITH {S}, d AS (SELECT server_ip AS corpus, CASE suite_code WHEN 4865 THEN 'TLS13' WHEN 49199 THEN 'ECDHE' WHEN 49156 THEN 'ECDH' WHEN 64250 THEN 'none' ELSE coalesce(CASE WHEN suite_code IS NOT NULL THEN 'RSA' END, 'none') END AS kex,
    CASE WHEN suite_code IN (4865, 49199) THEN 'true' WHEN suite_code IN (156, 5, 49156) THEN 'false' ELSE 'unknown' END AS fs, CASE WHEN tcp_stream_id % 2 = 0 THEN 'true' ELSE 'false' END AS xp FROM s)
  SELECT corpus, string_agg(DISTINCT kex, ',' ORDER BY kex) AS kex, string_agg(DISTINCT fs, ',' ORDER BY fs) AS forward_secret, string_agg(DISTINCT xp, ',' ORDER BY xp) AS x509_present FROM d GROUP BY 1""")
def feature_variance(spark, sf):
    from wirepost.operators import crypto
    s = crypto.enrich_suite(spark, lifts.flat_sessions(spark, sf))
    d = s.select(F.col("server_ip").alias("corpus"), F.when(F.col("is_tls13"), "TLS13").otherwise(F.coalesce("kex", F.lit("none"))).alias("kex"),
                 F.when(F.col("is_tls13"), "true").otherwise(F.coalesce(F.col("ephemeral").cast("string"), F.lit("unknown"))).alias("forward_secret"),
                 (F.col("tcp_stream_id") % 2 == 0).cast("string").alias("x509_present"))
    return evaluation.feature_variance(d)


_OURS = "SELECT capture_id || coalesce(protocol, '-') || coalesce(client_ip, '-') AS capture, count(protocol) AS sessions, coalesce(bool_or(adv_value = 'true'), false) AS advertised, count(DISTINCT ver_value) AS versions FROM {s} GROUP BY 1"
_THEIRS = "SELECT capture_id || coalesce(protocol, '-') || coalesce(client_ip, '-') AS capture, count(CASE WHEN packet_count % 3 = 0 THEN 1 END) AS capability_frames, count(CASE WHEN tls_state <> 'NONE' THEN 1 END) AS server_hellos FROM {s} WHERE server_port <> 110 GROUP BY 1"


@query("agreement", f"""WITH {S}, a AS ({_OURS.format(s='s')}), b AS ({_THEIRS.format(s='s')}), j AS (SELECT capture, coalesce(sessions, 0) AS n, coalesce(advertised, false) AS we, coalesce(versions, 0) AS v, coalesce(capability_frames, 0) > 0 AS wire, coalesce(server_hellos, 0) AS sh FROM a FULL JOIN b USING (capture)),
  k AS (SELECT *, CASE WHEN n = 0 THEN 'infrastructure' WHEN (sh > 0 AND v = 0) OR (wire AND NOT we) THEN 'parser-bug' WHEN we AND NOT wire THEN 'wrong-security-claim' ELSE 'agreed' END AS classification FROM j)
  SELECT capture, classification, CASE WHEN classification = 'agreed' THEN 'PASS' ELSE 'FAIL' END AS result FROM k""")
def agreement(spark, sf):
    lifts.flat_sessions(spark, sf).createOrReplaceTempView("flat_sessions")
    return evaluation.agreement(spark.sql(_OURS.format(s="flat_sessions")), spark.sql(_THEIRS.format(s="flat_sessions"))) \
        .select("capture", "classification", "result")


@query("separability")
def separability(spark, sf):
    lifts.register(spark, sf, "embeddings")
    m = spark.table("embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("row"), (F.col("vec_id") % 2).alias("generator"))
    return evaluation.separability(m, "generator", folds=5, trees=20)


# ----------------------------------------------------------------------------- whole lane
def lane(spark, sf):
    return anomaly.anomaly_lane(context(spark, sf))


@query("abstain", f"WITH {S} SELECT stream_key, CASE WHEN protocol IS NULL THEN 'no mail protocol' WHEN completeness <> 'COMPLETE' THEN 'completeness is ' || completeness END AS reason FROM s")
def abstain(spark, sf):
    return lifts.sessions(spark, sf).select("stream_key", anomaly.abstain_reason().alias("reason"))


@query("anomaly_lane", f"WITH {S}, {FT}, {LANE} SELECT capture_id, stream_key, round(score, 3) AS score, round(threshold, 3) AS threshold, band FROM ab")
def anomaly_lane(spark, sf):
    return lane(spark, sf).select("capture_id", "stream_key", F.round("score", 3).alias("score"), F.round("threshold", 3).alias("threshold"), "band")


_LB = ", ".join(f"count(CASE WHEN band = '{b}' THEN 1 END) AS {b.lower()}" for b in ("ANOMALOUS", "BORDERLINE", "NORMAL", "NOT_SCORED"))


_SUBSETS = evaluation.group_subsets()
_MASKS = ", ".join(f"('{n}', {i + 1})" for n, fids in _SUBSETS.items() for i, (_, f, _) in enumerate(anomaly.layout()) if f in set(fids))


@query("group_ablation", f"""WITH {S}, {FT}, {MX}, lb AS (SELECT mx.capture_id, mx.stream_key, r, CASE WHEN tcp_stream_id % 5 < 2 THEN 'TRAIN' WHEN tcp_stream_id % 5 = 2 THEN 'VALIDATION' WHEN tcp_stream_id % 5 = 3 THEN 'SELECT' ELSE 'TEST' END AS split,
    coalesce(auth_value = 'true', false) AND tls_state <> 'ESTABLISHED' AS attack, coalesce(implicit_tls, false) AS blind FROM mx JOIN s ON mx.stream_key = s.stream_key WHERE the_protocol IS NOT NULL AND the_completeness = 'COMPLETE'),
  lg AS (SELECT capture_id, stream_key, split, attack, blind, unnest(range(1, len(r) + 1)) AS c, unnest(r) AS v FROM lb WHERE NOT attack OR split IN ('SELECT', 'TEST')),
  md AS (SELECT capture_id, c, median(v) AS m FROM lg WHERE split = 'TRAIN' GROUP BY 1, 2),
  ma AS (SELECT lg.capture_id, lg.c, any_value(m) AS m, median(abs(v - m)) * 1.4826 AS sc FROM lg JOIN md ON lg.capture_id = md.capture_id AND lg.c = md.c WHERE split = 'TRAIN' GROUP BY 1, 2),
  mk(subset, c) AS (VALUES {_MASKS}),
  sx AS (SELECT lg.capture_id, subset, split, stream_key, any_value(attack) AS attack, any_value(blind) AS blind, round(sum(CASE WHEN sc < 0.000001 THEN CASE WHEN v = m THEN 0.0 ELSE 3.0 END ELSE abs(v - m) / sc END), 6) AS score
    FROM lg JOIN ma ON lg.capture_id = ma.capture_id AND lg.c = ma.c JOIN mk ON mk.c = lg.c WHERE split <> 'TRAIN' GROUP BY 1, 2, 3, 4),
  vr AS (SELECT capture_id, subset, score, row_number() OVER w AS rn, count(*) OVER (PARTITION BY capture_id, subset) AS n FROM sx WHERE split = 'VALIDATION' WINDOW w AS (PARTITION BY capture_id, subset ORDER BY score)),
  tl AS (SELECT capture_id, subset, score AS threshold FROM vr WHERE rn = round_even(0.95 * (n - 1), 0) + 1),
  cf AS (SELECT capture_id, subset, split, any_value(threshold) AS threshold, count(CASE WHEN score >= threshold AND attack THEN 1 END) AS tp, count(CASE WHEN score >= threshold AND NOT attack THEN 1 END) AS fp,
    count(CASE WHEN score < threshold AND attack THEN 1 END) AS fn, count(CASE WHEN score < threshold AND NOT attack THEN 1 END) AS tn FROM sx JOIN tl USING (capture_id, subset) WHERE split <> 'VALIDATION' GROUP BY 1, 2, 3),
  pt AS (SELECT capture_id, subset, split, score, count(CASE WHEN attack THEN 1 END) AS pos, count(CASE WHEN NOT attack THEN 1 END) AS neg FROM sx WHERE split <> 'VALIDATION' AND NOT blind GROUP BY 1, 2, 3, 4),
  cu AS (SELECT *, sum(pos) OVER w AS tps, sum(pos + neg) OVER w AS seen FROM pt WINDOW w AS (PARTITION BY capture_id, subset, split ORDER BY score DESC)),
  ar AS (SELECT capture_id, subset, split, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * tps / CAST(seen AS DOUBLE)) / sum(pos), 4) END AS pr_auc FROM cu GROUP BY 1, 2, 3)
  SELECT cf.capture_id, cf.subset, cf.split, round(threshold, 3) AS threshold, tp, fp, fn, tn, round((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 4) AS flag_rate, pr_auc, w AS columns
  FROM cf LEFT JOIN ar ON ar.capture_id = cf.capture_id AND ar.subset = cf.subset AND ar.split = cf.split JOIN (SELECT subset, count(*) AS w FROM mk GROUP BY 1) q ON q.subset = cf.subset""")
def group_ablation(spark, sf):
    """Logins in the clear as the thing to find; training and validation hold none."""
    ctx = context(spark, sf)
    at, attack = F.col("tcp_stream_id") % 5, F.coalesce(F.col("auth_activity.value") == "true", F.lit(False)) & (F.col("tls_state") != "ESTABLISHED")
    marked = ctx.filter(F.col("protocol").isNotNull() & (F.col("completeness") == "COMPLETE")).withColumns({
        "split": F.when(at < 2, "TRAIN").when(at == 2, "VALIDATION").when(at == 3, "SELECT").otherwise("TEST"),
        "attack": attack, "blind": F.coalesce("implicit_tls", F.lit(False))}).filter(~F.col("attack") | F.col("split").isin("SELECT", "TEST"))
    matrix = anomaly.written(anomaly.encode(anomaly.features(marked, keep=("split", "attack", "blind")), keep=("split", "attack", "blind")))
    return evaluation.group_ablation(matrix).select(
        "capture_id", "subset", "split", F.round("threshold", 3).alias("threshold"), "tp", "fp", "fn", "tn", "flag_rate", "pr_auc", "columns")


@query("lane_report", f"WITH {S}, {FT}, {LANE} SELECT capture_id, count(*) AS sessions_seen, count(score) AS sessions_scored, count(*) - count(score) AS abstentions, round(max(threshold), 3) AS threshold, {_LB} FROM ab GROUP BY 1")
def lane_report(spark, sf):
    return anomaly.lane_report(lane(spark, sf)).withColumn("threshold", F.round("threshold", 3))


@query("custom_anomaly_model", f"""WITH {S}, {FT}, {MX}, lg AS (SELECT capture_id, stream_key, unnest(range(1, len(r) + 1)) AS c, unnest(r) AS v FROM mx),
  mn AS (SELECT capture_id, c, avg(v) AS m FROM lg GROUP BY 1, 2),
  sc AS (SELECT lg.capture_id, stream_key, sqrt(sum(pow(v - m, 2))) AS score FROM lg JOIN mn ON lg.capture_id = mn.capture_id AND lg.c = mn.c GROUP BY 1, 2)
  SELECT sc.capture_id, sc.stream_key, CASE WHEN the_protocol IS NOT NULL THEN round(score, 3) END AS score, 'mean-distance' AS model FROM sc JOIN mx ON sc.stream_key = mx.stream_key""")
def custom_anomaly_model(spark, sf):
    found = anomaly.anomaly_lane(context(spark, sf), model=anomaly.MEAN_MODEL, judge_truncated=True)
    return found.select("capture_id", "stream_key", F.round("score", 3).alias("score"), "model")


_TOP = "row_number() OVER (PARTITION BY lg.capture_id, stream_key ORDER BY abs(CASE WHEN sc < 0.000001 THEN CASE WHEN v = m THEN 0.0 ELSE 3.0 END ELSE (v - m) / sc END) DESC, lg.c)"


@query("explained_anomalies", f"""WITH {S}, {FT}, {LANE}, tp AS (SELECT lg.capture_id, stream_key, lg.c - 1 AS at, {_TOP} AS place,
    abs(CASE WHEN sc < 0.000001 THEN CASE WHEN v = m THEN 0.0 ELSE 3.0 END ELSE (v - m) / sc END) AS contribution FROM lg JOIN ma ON lg.capture_id = ma.capture_id AND lg.c = ma.c)
  SELECT tp.capture_id, tp.stream_key, count(*) AS features, round(sum(contribution), 3) AS explained FROM tp JOIN ab ON ab.stream_key = tp.stream_key
  WHERE place <= 5 AND contribution > 1e-9 AND score IS NOT NULL GROUP BY 1, 2""")
def explained_anomalies(spark, sf):
    found = lane(spark, sf).filter("score is not null").select("capture_id", "stream_key", F.explode("top_features").alias("t"))
    return found.groupBy("capture_id", "stream_key").agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("t.contribution"), 3).alias("explained"))
