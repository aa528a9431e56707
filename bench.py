"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # one or more of every kind of plan: scan, merge join, grid join, fold, suppression, text
    "gap_cluster", "threshold_runs", "gap_with_boundary", "fixpoint_promote", "pattern_rewrite", "gap_expiring_fill",
    "asof_backward", "segment_by_boundary", "proximity_anti", "two_stage_assign", "greedy_pair", "interval_overlap_sum",
    "stacked_pairs", "nms_overlap", "nms_center", "sweep_keep_best", "pair_dedupe", "seed_cluster", "line_pack",
    "upper_median", "mode_first_seen", "rollup_totals", "budget_check", "deficit_alloc", "surplus_reduce", "swap_fixpoint",
    "proportional_alloc", "provenance_tag", "rest_adjust", "sections_from_text", "accuracy_metrics", "flag_report",
    "tokenize_events", "modular_map",
]


def main() -> None:
    from glyphline.plans.queries import QUERIES
    from glyphline.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    # start the JVM's and the Python workers' machinery before timing
    for name in ("gap_cluster", "line_pack"):
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
