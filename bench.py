"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
Each query is run once for warm-up and once timed; results go to a no-op sink so
that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gridlake.suite.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "html_order_totals",
    "html_span_grid",
    "html_nested_rank",
    "table_ids",
    "code_block_tables",
    "csv_docs_parsed",
    "text_tables_union",
    "json_tables",
    "page_ranges",
    "clean_grid",
    "infer_types_corpus",
    "infer_types_wide",
    "header_types",
    "stats_numeric",
    "stats_categorical",
    "stats_wide",
    "filter_combined",
    "sort_numeric",
    "row_numbers",
    "apply_view_rows",
    "export_csv",
    "upsert_by_key",
    "monthly_usage",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name, warm if os.path.isdir(warm) else sf)
        timings[name] = run(name, sf)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
