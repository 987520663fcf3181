"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Every query is forced to full execution with the
``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capaflow.catalog import all_queries  # noqa: E402
from capaflow.session import build_session, remove_staged  # noqa: E402

HEADLINE = ["weekly_plan", "alc_01", "alc_04", "alc_06", "alc_10", "agg_11", "rpt_01", "rpt_02",
            "prj_03", "alc_17", "lkp_02", "est_04", "str_01"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    qs = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM start-up, not a query
    times = {}
    failed = {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 -- report, keep the JSON line
            failed[name] = str(e).splitlines()[0][:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    remove_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
