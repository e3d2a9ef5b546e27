"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds per query.

The graph tables that a sync run writes are built first and reported as ``prepare``. Every query
then runs once to warm up and three times for its median; a run writes all rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollbook.plans.catalog import QUERIES  # noqa: E402
from rollbook.plans.store import store  # noqa: E402
from rollbook.session import build_session  # noqa: E402

HEADLINE = [
    "reg_1", "reg_3", "reg_8", "reg_10", "qa_9", "qa_14", "gra_1", "gra_5", "gra_8", "sc_2", "r_b1", "r_b1s", "r_b2", "r_b3", "r_e1", "run_1", "dsh_7", "dsh_12", "dsh_20", "dsh_30",
    "elg_5", "elg_11", "elg_24", "elg_34", "doc_2", "doc_4", "doc_5", "doc_8", "doc_10", "qry_3",
]
TABLES = ["person_detail", "enrollments", "profile_raw", "scheme_names", "schemes", "places", "enrollment_nodes", "member_of", "scored", "dup", "dob", "state", "flags"]


def run(build) -> float:
    """Seconds from the call of the query to its last row; what a query writes on the way counts."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    keys = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.perf_counter()
    s = store(spark, sf)
    for name in TABLES:
        getattr(s, name)
    prepare = time.perf_counter() - t0
    times = {}
    for key in keys:
        build = lambda k=key: QUERIES[k](spark, sf)
        run(build)
        times[key] = round(statistics.median(run(build) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
        "prepare": round(prepare, 3), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
