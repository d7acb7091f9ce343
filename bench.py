"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the test tables, BENCH_CPUS the cores. Each query is run once to warm up, then BENCH_RUNS times; its
result is written to a sink that keeps nothing, so that every row and column is computed. The value is the sum of the
medians. Beside it, `extra` has the times of a generated day of stop events of real size (BENCH_DAY_ROWS rows in one
semicolon-separated file of 21 columns): reading and parsing it, and doing so with all statistics.
"""

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from headwind.operators import services  # noqa: E402
from headwind.operators.observations import extract_observations  # noqa: E402
from headwind.plans.catalogue import QUERIES  # noqa: E402
from headwind.session import build_session  # noqa: E402
from headwind.sources import readers  # noqa: E402

HEADLINES = ("service_stats_sets", "order_delay_stats", "departures_with_delays", "obs_parse_filter", "departures_around", "stop_patterns", "trip_tail")


def write_day(spark, folder: str, rows: int) -> str:
    """A day of stop events as one file: `rows` departures at 24,000 stations under 1,200 lines."""
    k = F.col("id")
    second = (k * 7919) % 86_400
    stamp = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_772_668_800) + s), "dd.MM.yyyy HH:mm:ss")
    filled = [F.lit(f"value of column {i}").alias(f"COLUMN_{i}") for i in range(12)]
    day = spark.range(rows).select(
        F.lit("05.03.2026").alias("BETRIEBSTAG"), *filled[:4], F.concat(F.lit("S"), k % 1200).alias("LINIEN_TEXT"), F.when(k % 50 == 0, "true").otherwise("false").alias("ZUSATZFAHRT_TF"),
        F.when(k % 40 == 0, "true").otherwise("false").alias("FAELLT_AUS_TF"), *filled[4:], (8_500_000 + (k * 31) % 24_000).cast("string").alias("BPUIC"), stamp(second - second % 60).alias("ABFAHRTSZEIT"),
        stamp(second + (k * 13) % 300 - 60).alias("AB_PROGNOSE"), F.when(k % 9 == 0, "PROGNOSE").otherwise("REAL").alias("AB_PROGNOSE_STATUS"), F.lit("false").alias("DURCHFAHRT_TF"),
    )
    day.coalesce(1).write.csv(folder, sep=";", header=True)
    return next(str(p) for p in Path(folder).glob("*.csv"))


def timed(make, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir), runs) for name in HEADLINES}
    rows, folder = int(os.environ.get("BENCH_DAY_ROWS", "2400000")), tempfile.mkdtemp(prefix="headwind-bench-")
    try:
        path = write_day(spark, f"{folder}/day", rows)
        read = lambda: extract_observations(readers.read_stop_events(spark, [path]))
        extra = {"day_rows": rows, "day_mb": round(os.path.getsize(path) / 1e6), "day_extract": timed(read, runs), "day_extract_and_statistics": timed(lambda: services.service_statistics(read()), runs)}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "sum of median wall times of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs, "extra": extra}))


if __name__ == "__main__":
    main()
