"""Time every registered query: one warm-up, then the median of the timed runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores,
BENCH_RUNS the timed runs, BENCH_QUERIES a comma-separated subset. A query is
not repeated once its timed runs have taken ten seconds together.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from tideline.session import build_session
from tideline.workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CHOSEN = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        int(CPUS),
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    seconds, exchanges = {}, {}
    for name in CHOSEN:
        query = QUERIES[name]
        df = query(spark, SF_DIR)
        run(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = len(re.findall(r"Exchange (?:hash|range|Single|rebalance)", plan.split("Initial Plan")[0]))
        times = []
        while len(times) < RUNS and sum(times) < 10:
            start = time.perf_counter()
            run(query(spark, SF_DIR))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]} s, {exchanges[name]} exchanges", file=sys.stderr, flush=True)
    match = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_seconds_all_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "exchanges": exchanges,
        "sf": float(match.group(1)) if match else SF_DIR,
    }))


if __name__ == "__main__":
    main()
