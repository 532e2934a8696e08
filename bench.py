"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tandemrank.catalog import load  # noqa: E402
from tandemrank.session import local_session, release  # noqa: E402

HEADLINE = [
    "positions", "curve_summary", "concordance_curve", "kendall_tau", "spearman", "tail_agreement", "cutoff_diagnostics",
    "retention_map", "raw_value_summary", "threshold_screening", "ks_statistic", "cluster_bootstrap_tau",
    "cluster_bootstrap_curves", "permutation_pvalue", "portfolio_benchmark", "full_procedure_bootstrap",
    "tensor_score_table", "discrepancy_hierarchy", "pair_quarantine", "robustness", "baseline_matrix",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load()
    # Start the JVM's and the Python workers' machinery outside the clock.
    queries["kendall_tau"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
