"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "energy_jumps", "onset_strength", "percentile_normalize", "quiet_passages", "loudest_window", "exponential_smooth",
    "auto_gain", "section_distribution", "asof_last_event", "nearest_event", "event_envelope", "sample_linear",
    "offset_curve", "local_lags", "classify_lags", "bar_changes", "autocorrelation", "fold_search", "note_pairing",
    "chord_lookup", "best_match", "cut_plan", "spec_findings", "rule_breaks", "scrub_text", "vector_novelty",
    "top_k_per_group", "stream_levels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from tidewheel.plans import registry
    from tidewheel.session import build_session, release

    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # Start the JVM's and Python's workers before anything is timed.
    queries["vector_novelty"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        release()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
