"""Time the headline queries and print one JSON line.

Each query writes its whole result to a no-op sink. One warm-up, then the median of
``BENCH_RUNS`` (default 3) runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quotemill.catalog import QUERIES  # noqa: E402
from quotemill.session import local_session  # noqa: E402

HEADLINE = [
    "daily_return",
    "clean_prices",
    "training_series",
    "forecast",
    "metrics",
    "yhat_density",
    "predict_point",
    "predict_range",
    "fit_decomposable",
    "forecast_decomposable",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("quotemill-bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
                "cpus": cores,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
