"""Wall time of the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Queries that took under ``SHORT`` seconds run three times, and their median counts: a single run of them is mostly noise.
``controls`` are queries whose code doesn't change from round to round: they show how fast the machine was.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
QUERIES = ["gallery_full", "gallery_top_runners", "event_stats", "export_payload", "fuzzy_lev1_pairs", "review_gate", "burst_support", "evidence_merge", "eval_by_group", "threshold_sweep", "session_quota", "upsert_merge", "exact_dupes_first_kept", "find_runner_answers", "burst_resolution"]

CONTROLS, SHORT = ["session_quota", "exact_dupes_first_kept", "threshold_sweep"], 6.0


def main() -> None:
    from pyspark.sql import SparkSession

    from stridemark.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # the session's own start
    for name in QUERIES:
        took: list[float] = []
        while not took or (took[0] < SHORT and len(took) < 3):
            began = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "controls": {n: seconds[n] for n in CONTROLS}, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
