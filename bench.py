"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median, and `value` is the sum of the headline queries. What
is built once and read often (the full-text index, the sorted table of pages) is built before; `built` says how long that took.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from traceloom.session import local_session

HEADLINE = ("search_like", "search_regex", "search_fuzzy", "search_fts", "sort_page_ts", "filter_layers", "histogram_hour", "stack_event_type", "stack_part_brand", "gap_sessions", "burst_windows", "coverage_by_source", "group_drilldown", "merge_timelines", "ioc_match_counts")


def prepared(spark, sf_dir: str) -> tuple[dict, dict]:
    """(queries on structures that are there, seconds in which they were built)."""
    from pyspark.sql import functions as F

    from traceloom.operators import fulltext, sorted_table

    docs, lines, built = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {}
    began = time.perf_counter()
    index = fulltext.build_index(docs, ["text", "source"], "doc_id")
    built["index_search"] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    table = sorted_table.write_sorted(lines, ["l_extendedprice", "l_orderkey", "l_linenumber"])
    built["keyset_page"] = round(time.perf_counter() - began, 3)
    middle = lines.select(F.percentile_approx("l_extendedprice", 0.5)).first()[0]
    return {"index_search": lambda: index.found('license "apache license"'), "keyset_page": lambda: table.page((middle, 0, 0), 500)}, built


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "12g", "bench")
    from traceloom.plans.registry import QUERIES

    took, (ready, built) = {}, prepared(spark, sf_dir)
    for name, made in [*((n, lambda q=QUERIES[n]: q(spark, sf_dir)) for n in HEADLINE), *ready.items()]:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            made().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "built": built, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
