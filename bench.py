"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from queries import catalogue  # noqa: E402
from wirepost.plans.session import build  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["run_rules", "build_baseline", "evaluate_contrast", "cross_findings", "issue_groups", "posture_score",
            "population_stats", "detector_d2_contrast", "walk_states", "feat_structure", "fit_robust",
            "ranking_metrics", "project_frames", "anomaly_lane", "assess_posture", "reconstruct_sessions"]
SESSION_QUERIES = {"run_rules", "build_baseline", "evaluate_contrast", "cross_findings",
                   "issue_groups", "posture_score", "feat_structure", "anomaly_lane", "assess_posture"}


def main() -> None:
    spark = build(f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    sessions = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    queries = catalogue.queries()
    timings = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    per_session = {n: round(1000 * t / sessions, 4) for n, t in timings.items() if n in SESSION_QUERIES}
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": SF_DIR.rsplit("sf", 1)[-1], "sessions": sessions,
                      "ms_per_session": per_session}))


if __name__ == "__main__":
    main()
