"""Seconds of the headline queries on local cores; prints one line of JSON.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of cores. Each query
runs once to warm up, then three times; the least time counts. Results go to
Spark's noop sink, so that every row is made and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from heddle.operators import QUERIES
from heddle.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flagship", "bench_scan", "bench_scan_lines", "bench_filter", "bench_count", "bench_group", "bench_sum_avg", "bench_join", "bench_join3", "bench_in_subquery", "bench_order_by", "bench_top100",
    "agg_group_multi", "agg_count_distinct", "win_running", "win_rank", "set_except_all", "sub_correlated", "cte_reuse", "composite_q91", "composite_q97", "composite_q100", "dml_update", "dml_delete",
]


def main() -> None:
    spark = session(f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "sum of the headline queries' seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
