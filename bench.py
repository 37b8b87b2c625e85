"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from floorlake import plans
from floorlake.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "building_report", "finding_merge", "building_rollup", "root_cause_groups", "run_trajectory", "room_digests", "render_work_list", "contained_by",
    "integrity_report", "footprint_collisions", "placement_issues", "layer_roles", "label_roles", "segments_in_metres", "evidence_fusion", "asset_matches",
    "fused_objects", "overlap_suppression", "image_statistics", "colour_axis",
]


def main() -> None:
    spark = local_session(CPUS, "floorlake-bench")
    # One untimed query first, so the JVM start-up is not charged to the first headline query.
    plans.QUERIES["axis_merge"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        if name not in plans.QUERIES:
            continue
        start = time.perf_counter()
        plans.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
