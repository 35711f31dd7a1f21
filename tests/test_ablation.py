"""Ablation of feature groups, from a matrix of a few rows."""

from wirepost.operators import anomaly, evaluation


def test_ablation_judges_by_the_columns_of_a_subset(spark):
    """A column that is constant in training gives 3 where a row differs; the other subset does not see it."""
    at = {c: i for i, c in enumerate(anomaly.COLUMNS)}

    def row(*ones):
        return [1.0 if i in {at[c] for c in ones} else 0.0 for i in range(len(at))]
    odd = row("has_greeting")
    rows = [("c", row(), "TRAIN", False, False)] * 4 + [("c", row(), "VALIDATION", False, False), ("c", odd, "VALIDATION", False, False)] \
        + [("c", odd, "TEST", True, False), ("c", row(), "TEST", False, False), ("c", odd, "TEST", True, True), ("alone", odd, "TEST", True, False)]
    matrix = spark.createDataFrame(rows, "capture_id string, row array<double>, split string, attack boolean, blind boolean")
    found = evaluation.group_ablation(matrix, {"protocol": ["has_greeting"], "tls": ["tls_records_present"]}, quantile=0.9)
    got = {r.subset: (r.capture_id, r.split, r.threshold, r.tp, r.fp, r.fn, r.tn, r.flag_rate, r.pr_auc, r["columns"]) for r in found.collect()}
    assert got == {"protocol": ("c", "TEST", 3.0, 2, 0, 0, 1, 0.6667, 1.0, 1), "tls": ("c", "TEST", 0.0, 2, 1, 0, 0, 1.0, 0.5, 1)}
