"""Benchmark: headline queries, warm, median of three runs; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from switchyard.catalog import QUERIES  # noqa: E402
from tests.session import make_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

HEADLINE = (
    "a01_benchmark_items",
    "a04_mean_costs",
    "a07_exact_split",
    "b03_b12_surface_features",
    "b13_hash_flags",
    "b18_shape_top",
    "b20_feature_map",
    "c02_one_hot",
    "c03_hash_embedding",
    "d03_unique_records",
    "d08_assignment",
    "d18_resolved_probs",
    "e07_training_target",
    "f06_target_grid",
    "g02_g14_log_overall",
    "g21_log_calibration_bins",
    "g27_frontier",
    "g29_subgroups",
)
# Jobs with several fits run once.
JOBS = ("f05_train_and_evaluate", "f03_batch_routing")


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = make_session()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run(spark, name)  # warm up: class loading, generated code, file cache
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(3)), 3)
    for name in JOBS:
        seconds[name] = round(run(spark, name), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cores": spark.sparkContext.defaultParallelism,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
