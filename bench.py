"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinespark.plans import catalog  # noqa: E402
from kinespark.session import build_session  # noqa: E402

HEADLINE = [
    "time_domain_features",
    "time_domain_by_supplier",
    "bilateral_merge",
    "zero_crossings",
    "stance_swing",
    "local_maxima_by_supplier",
    "peaks_by_supplier",
    "stride_symmetry",
    "low_pass_filter",
    "cross_limb_cycles",
    "asymmetry_alerts",
    "spectral_windows",
    "sliding_window_extremes",
    "detection_windows_by_supplier",
    "detection_raw_windows",
    "subject_dataset",
    "normalised_channels",
    "correlation_matrix",
    "point_biserial",
    "standardised_columns",
    "group_folds",
    "canonical_file_scan",
    "streamed_window_extremes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
