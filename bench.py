"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
Each query's result is written to Spark's noop sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tabscope import catalog
from tabscope.operators.investigate import investigate
from tabscope.plans.stored import cleanup, stored
from tabscope.session import local_session

HEADLINE = (
    "missing_summary", "duplicate_texts", "duplicate_subset", "column_profile", "numeric_stats", "categorical_stats",
    "outlier_stats_lineitem", "correlation_pearson", "correlation_spearman", "correlation_kendall", "associations",
    "separation_accuracy", "duplicate_column_pairs", "leakage_signals", "delimited_table", "anomaly_summary", "text_to_numbers", "cleaned_table", "investigation_findings",
)

SMALL_ROWS = 1_508


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores))
    catalog.load()
    catalog.table(spark, folder, "lineitem").count()  # start executors and file readers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        cleanup(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = catalog.table(spark, folder, "lineitem").count()
    small = stored(catalog.table(spark, folder, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(SMALL_ROWS), "small")
    start = time.perf_counter()
    investigate(small).tables["findings"].collect()
    small_seconds = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
        "investigation_rows_per_sec": round(rows / seconds["investigation_findings"], 1),
        f"investigation_of_{SMALL_ROWS}_rows_sec": small_seconds,
    }))


if __name__ == "__main__":
    main()
