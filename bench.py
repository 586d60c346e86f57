"""Time the headline queries: BENCH_SF_DIR and BENCH_CPUS set the data and the cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vantage.plans import QUERIES
from vantage.session import build_session

HEADLINE = [
    "c1_venue_readings", "d7_hourly_pattern", "c2_history_summary", "d13_normalised_cells", "e5_cell_labels",
    "e16_duplicate_groups", "d1_merged_events", "a13_event_upsert", "h11_clean_descriptions", "h13_classified",
    "h15_photo_scores", "b20_repair_rows", "e12_canonical_names", "a5_structured_events", "a8_traffic_observations",
    "e11_sampled_lines", "c5_events_at_venues", "a17_calendar_entries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the workers and compiles common code; not timed.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
