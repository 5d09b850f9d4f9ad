"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of local cores. Every
query runs once to warm the JVM up and is then timed, fits included, with its whole result
computed.
"""

from __future__ import annotations

import json
import os
import time

from lustra import build_session
from lustra.plans.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "clean_orders",
    "clean_check_prepare",
    "blank_to_null",
    "numeric_coerce",
    "dedup_first",
    "dedup_none",
    "dedup_documents",
    "zeros_group_mean",
    "fill_median",
    "fill_mode",
    "ffill_events",
    "outlier_iqr_cap",
    "outlier_iqr_drop",
    "outlier_z_drop",
    "scale_standard",
    "label_encode",
    "onehot",
    "date_parts",
    "agg_feature_mean",
    "agg_feature_median",
    "agg_feature_nunique",
    "check_suite",
    "profile_quality",
    "profile_describe",
    "csv_round_trip",
    "parquet_round_trip",
)


def run(name: str, spark) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    partitions = {"spark.sql.shuffle.partitions": CPUS}
    spark = build_session(f"local[{CPUS}]", "lustra-bench", **partitions)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(name, spark)
        seconds[name] = round(run(name, spark), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
