"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and run a few times in one warm session; the median counts,
plan construction included.  Results go to the ``noop`` sink, so every column is
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditflow.operators.score import audit  # noqa: E402
from auditflow.plans import inputs, queries  # noqa: E402

HEADLINE = {
    "findings_by_label": queries.findings_by_label,
    "page_findings": queries.page_findings,
    "severity_and_risk": queries.severity_and_risk,
    "top_risk_documents": queries.top_risk_documents,
    "full_audit": lambda spark, d: audit(inputs.documents(spark, d)),
    "full_audit_notes": lambda spark, d: audit(inputs.notes(spark, d)),
    "exposure_rollup": queries.exposure_rollup,
    "vault_latest": queries.vault_latest,
    "stable_tokens": queries.stable_tokens,
    "roundtrip_violations": queries.roundtrip_violations,
    "log_written": queries._new_log,
    "category_buckets": queries.category_buckets,
    "pause_gate_asof": queries.pause_gate_asof,
    "retain_last_by_user": queries.retain_last_by_user,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("auditflow-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    size = inputs.documents(spark, sf_dir).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    times = {}
    for name, query in HEADLINE.items():
        runs = []
        for _ in range(1 + repeats):  # the first run warms up and does not count
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    audit_time = times["full_audit"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "audit_docs_per_sec": round(size[0] / audit_time), "audit_mb_per_sec": round(size[1] / 1e6 / audit_time, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
