"""Headline queries timed once each after a warm-up: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossier.queries import QUERIES  # noqa: E402
from dossier.session import local_session  # noqa: E402

HEADLINES = (
    "risk_distribution", "dashboard_summary", "volume_trend", "stage_latency", "workspace_summary", "edit_rights",
    "history_listing", "case_card", "normalised_fields", "search_index", "evidence_search", "consistency_findings",
    "comparison_table", "fusion_matrix", "validation_checks", "rule_age", "mrz_parse", "extract_fields",
    "classify_documents", "exact_reuse", "near_reuse", "feature_match", "report_modules", "risk_score",
    "audit_digest", "audit_links", "audit_verify")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    QUERIES["risk_distribution"](spark, folder).collect()  # start the engine
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
