"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores, BENCH_QUERIES (comma separated) other queries than these.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_cases", "extract_payslip_fields", "structural_features", "classify_document_type", "salary_outlier", "structural_anomaly",
    "duplicate_documents", "device_clone_24h", "impossible_travel", "repeat_pattern", "fingerprint_similarity", "registry_verify_company",
    "font_audit", "ela_score", "build_case_graph", "all_rings", "risk_propagation_all", "ledger_report",
]


def main() -> None:
    from docsentry import session
    from docsentry.plans import catalog

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false", "spark__driver__memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = catalog.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
