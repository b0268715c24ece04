"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trajlens.plans import QUERIES  # noqa: E402
from trajlens.session import build_session  # noqa: E402

HEADLINE = [
    "session_overview", "sliding_entropy", "sliding_mi", "sliding_surprisal", "baseline_kl", "sliding_compression",
    "phase_machine", "phase_segment_stats", "metric_anomalies", "detect_error_cascade", "detect_context_loss", "detect_stall",
    "detect_recovery_failure", "information_features", "workload_features", "awareness_features", "error_recovery_features",
    "coherence_features", "write_read_signals", "stale_reads", "rater_pair_kappa", "alpha_ordinal", "ground_truth",
    "detector_scores", "threshold_sweep", "cognition_memory", "decision_points", "trace_features", "reprompts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("OFF")
    # The first query pays for starting the JVM and Python workers.
    QUERIES["session_overview"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
