"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tecflow.plans import registry
from tecflow.session import session

HEADLINES = ("roti_chain", "roti_window", "s4c", "anomaly_clean", "slip_repair", "hatch", "rms_hourly", "result_stats", "pair_gradient", "knn_lagrange", "asof_last", "clock_interp", "idw", "bandpass", "union_dedupe")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
