"""Time the headline queries: one JSON line with the seconds of each.

Every query is planned and run twice over whole tables, its result going to
the no-op sink; the better run counts.  Documents are dealt to as many partitions as there are cores, which is part of the
time: the given table is one row group, so without it one task would do all the work.
"""

import json
import os
import re
import time

from siftlines import session
from siftlines.plans import queries
from siftlines.operators import lines
from siftlines.plans import corpus

HEADLINE = [
    "scan_all_rules", "scan_rule_file", "scan_rule_table", "risk_severity_first", "risk_density", "category_counts",
    "cross_file_rules", "top_risky_files", "finding_snippets", "block_chunks", "chunk_bounds", "chunk_findings",
    "narrative", "call_features", "prompt_text", "sequence_rules", "file_results", "group_overview",
    "json_findings", "metric_rollup", "phase_durations", "elapsed_series",
]


def seconds(spark, run) -> float:
    spark.catalog.clearCache()  # nothing of an earlier run is used again
    begun = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    corpus.PARTITIONS = int(cores)
    registered = queries.all_queries()
    times = {name: round(min(seconds(spark, lambda: registered[name](spark, folder)) for _ in range(2)), 3)
             for name in HEADLINE}
    n_lines = lines.scan_lines(corpus.code_files(spark, folder)).count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "partitions": corpus.PARTITIONS,
        "sf": float(re.search(r"sf([\d.]+)", folder).group(1)) if re.search(r"sf([\d.]+)", folder) else folder,
        "lines": n_lines, "lines_per_sec": {q: round(n_lines / times[q]) for q in (
            "scan_all_rules", "scan_rule_file", "scan_rule_table")}}))
    spark.stop()


if __name__ == "__main__":
    main()
