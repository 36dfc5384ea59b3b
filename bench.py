"""Throughput bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full through Spark's ``noop`` sink (every row
computed, nothing collected), once to warm up and then ``$BENCH_REPS``
times; the per-query figure is the median.  Prints one JSON line.

statistics and interactions over the signal arrays, global position / folds
/ decay weights over events, a wide-table profile, and the cleaning policy,
scaling, metric and selection queries around them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "features_a_bulk",
    "features_b_bulk",
    "features_a",
    "features_b",
    "policy_p2",
    "row_stats",
    "log_interactions",
    "global_position",
    "contiguous_kfold",
    "time_decay_weights",
    "outlier_downweight",
    "standardize",
    "robust_scale",
    "regression_metrics",
    "f_score_top_k",
    "attach_predictions",
    "wide_profile",
]


def main() -> None:
    from flowbook.plans.queries import REGISTRY
    from flowbook.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in REGISTRY]
    # The tables are files of one row group: deal their rows out over the cores.
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(app_name="flowbook-bench", extra={"flowbook.scan.partitions": cpus})
    timings: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "reps": reps,
    }))


if __name__ == "__main__":
    main()
