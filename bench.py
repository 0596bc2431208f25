"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8),
BENCH_QUERIES a comma-separated choice (default the list below; ``all`` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketlens.plans import registry
from docketlens.plans.tables import SPREAD
from docketlens.session import build_session

HEADLINE = [
    "row_accounting", "docket_lifecycle", "survival_curve", "survival_quantiles", "court_extract_accounting",
    "docket_merge", "docket_hits", "snapshot_lifecycle", "lifecycle_events", "page_dedupe", "agency_records",
    "sensitive_screen", "session_preferences", "ranked_matches", "screened_candidates", "facet_counts",
    "unified_catalog", "ledger_apply", "claim_activity", "docket_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    shared = tempfile.TemporaryDirectory(prefix="docketlens-bench-")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.checkpoint.dir": shared.name, "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
            # Small tables on one machine: let a scan use every core.
            "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "1m", SPREAD: cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
