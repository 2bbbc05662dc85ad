"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     threads of the local session (default 8)
BENCH_RUNS     runs of each query, of which the median counts (default 3)
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import QUERIES  # noqa: E402

HEADLINE = [
    "document_lines", "rule_matches", "rule_matches_by_join", "combinations", "entropy_candidates", "obfuscation_scores",
    "permission_requests", "addresses", "indicators_per_file", "syntax_facts", "merged_findings", "file_risk",
    "deep_file_risk", "repo_risk", "page_admission", "site_risk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, first = {}, {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], first[name] = round(median(runs), 3), round(runs[0], 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, planning included", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "first_runs": first, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
