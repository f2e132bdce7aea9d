"""Time the headline queries: $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from freshet.queries import QUERIES
from freshet.session import build_session

HEADLINE = [
    "m8_label_gauges",
    "w5_gap_fill_even",
    "w3_gap_fill_hourly",
    "w6_flood_label",
    "w9_lag_features",
    "w10_rolling_features",
    "w12_flood_features",
    "m1_build_flood_dataset",
    "a3_iqr_bounds",
    "p2_validate_gauge",
    "j4_grid_day_labels",
    "m2_build_landslide_dataset",
    "w13_landslide_features",
    "j8_zones_near_points",
    "f18_user_priority",
    "t6_dispatch_queue",
    "f15_alerts_from_zones",
    "j9_route_zones",
    "f20_route_status",
    "s1_read_landslide_catalog",
    "a13_roc_pr_auc",
    "t1_top_drivers",
    "r5_flow_direction",
    "r6_flow_accumulation",
    "r9_hand",
    "t8_positional_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    # start the executors and compile what every query needs, on the first query itself
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
