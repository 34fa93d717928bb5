"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8)
the number of local cores, BENCH_RUNS (default 3) the timed runs per query after
one warm-up; the median counts.
"""

import json
import os
import statistics
import sys
import time

import workload
from tools.session import local_session

HEADLINES = [
    "pricing_summary", "filter_arith", "filter_not_in_subquery", "filter_in_subquery_or", "filter_all_gt",
    "join_inner", "join_full", "join_multi_key", "agg_distinct", "agg_having", "describe_numeric",
    "exact_quantiles", "topk", "position", "position_hot_key", "position_of_scan", "slice_range", "slice_list",
    "hstack_prefix", "vstack_positions", "alg_chain", "alg_frame_add", "matmul_array", "gram", "gram_wide",
    "matmul_long", "transpose_long", "udf_table", "udf_groups", "udf_matrix", "load_partitioned",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        measured = [seconds(lambda: workload.QUERIES[name](spark, folder)) for _ in range(runs + 1)]
        times[name] = round(statistics.median(measured[1:]), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, median seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(scale) if scale else None}))


if __name__ == "__main__":
    main()
