"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query after one warm-up run; the median is reported (default 1)
    BENCH_QUERIES  comma-separated names, or `all`
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sigframe import catalog
from sigframe.session import local_session

HEADLINE = [
    "clicks_per_stream", "robust_residual", "signal_stats", "rms_envelope", "remove_dc", "pcm_convert", "running_limiter", "delta_decode",
    "resample_linear", "resample_sinc", "convolve_taps", "convolve_blocks", "grain_stretch", "argmin_bin", "affine_scan", "eq6", "echo", "dft",
    "change_mask", "forward_fill", "shrink", "timeline", "position_at", "conformance", "duplicate_patterns", "usage_cube", "trace_diff",
    "expand_orders", "append_cells", "remap_ids", "instrument_samples", "route_controls", "envelope_at", "collect_outputs", "read_cue",
    "dedupe_identical", "tree_signature", "validate_stream_header", "normalise_newlines", "candidate_score", "geomean", "meter", "stream_limiter",
]


def run(spark, name: str, d: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog.load()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, d)
        times[name] = round(statistics.median(run(spark, name, d) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
