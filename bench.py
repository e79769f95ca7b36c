"""Prints one JSON line: seconds of every headline query over the normalised star, the materialised view, and
the view with fresh rows."""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import SparkSession

from asterfold import registry
from asterfold.plans import ssb

HERE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
#: Names, comma-separated; all headline queries if empty.
ONLY = os.environ.get("BENCH_ONLY", "")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [*ssb.QUERIES, *(f"mv_{q}" for q in ssb.QUERIES), *(f"delta_{q}" for q in ("q11", "q12", "q13", "q21", "q22", "q23"))]
    names = ONLY.split(",") if ONLY else names
    queries, seconds = registry.queries(), {}
    began = time.perf_counter()
    queries["mv_q11"](spark, HERE).collect()
    build = time.perf_counter() - began
    for name in names:
        queries[name](spark, HERE).collect()  # compiles
        times = []
        for _ in range(RUNS):
            at = time.perf_counter()
            queries[name](spark, HERE).collect()
            times.append(time.perf_counter() - at)
        seconds[name] = round(min(times), 4)
    total = sum(seconds.values())
    geo = math.exp(sum(map(math.log, seconds.values())) / len(seconds))
    print(json.dumps({"metric": "total_seconds", "value": round(total, 4), "unit": "sec", "queries": seconds, "sf": float(HERE.rsplit("sf", 1)[-1]) if "sf" in HERE else None, "geometric_mean": round(geo, 4), "arithmetic_mean": round(total / len(seconds), 4), "view_build": round(build, 3), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
