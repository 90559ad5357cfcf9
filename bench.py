"""Times the headline queries: plan-build and execution, the median of three after one warm-up. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from quillsift.plans.queries import QUERIES

#: The case shapes of the reference's published benchmark, on customer, orders, lineitem and part.
HEADLINE = {
    "property": "prop_eq", "aggregate_or_property": "agg_or_property", "zero_count": "agg_count_scoped_zero", "computed": "computed_nested", "nested_scoping": "assoc_nested_scoping",
    "has_any": "assoc_has_any", "has_all": "assoc_has_all", "only_has_any": "assoc_only_has_any", "only_has_all": "assoc_only_has_all", "scoped_not_has_all": "assoc_has_all_scoped_global",
    "paged": "caller_page_preserved", "top_n": "assoc_top_n", "distinct_ranked": "assoc_distinct_ranked", "flagship": "flagship",
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, plans = {}, {}
    for name, query in HEADLINE.items():
        runs, builds = [], []
        for _ in range(4):
            start = time.perf_counter()
            df = QUERIES[query](spark, sf_dir)
            built = time.perf_counter()
            df.count()
            runs.append(time.perf_counter() - start)
            builds.append(built - start)
        seconds[name], plans[name] = round(median(runs[1:]), 4), round(1000 * median(builds[1:]), 1)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "plan_ms": plans, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
