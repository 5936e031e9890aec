"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores. Each query is
planned and run in full into the no-op sink: one cold run, then ``BENCH_WARM`` warm ones
(default 1) of which the median counts. Size checks that a query makes while it is planned are
part of its time.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "attribution_report span_merge span_merge_items activity_union idle_gaps fit_zoom display_cols gantt_nodes gantt_lanes "
    "fs_coalesce echo_suppress attribution provenance call_pairs turn_close gen_intervals session_rollup action_facets "
    "detail_list nearest nth_activity recency_rank path_rollup presence deleted_paths compact_paths tree_order touching "
    "longest_prefix asof_prev line_churn apply_edits"
).split()


def main() -> None:
    from tracelane.plans.registry import QUERIES
    from tracelane.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus=cpus, partitions=cpus, app="bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    names = sys.argv[1:] or HEADLINE
    warm = int(os.environ.get("BENCH_WARM", "1"))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(1 + warm):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        cold[name] = round(runs[0], 3)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
                "cold": cold,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
