"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from paperloom.plans import registry
from paperloom.session import session

HEADLINE = [
    "final_score", "flow_summary", "referee_load", "dashboard", "counts_two_levels", "latest_per_group", "awaiting_reply", "referee_alias",
    "score_sheet", "having_audit", "referee_work_list", "doc_key", "token_stats", "language_id", "term_profile", "category_verdict",
    "sentence_commonness", "boilerplate_overlap", "hamming_pairs", "html_links", "event_sessions",
    "balanced_assignment", "evaluation_gate", "reports_by_number", "document_status", "similarity_classes",
    "document_sections", "category_sheets",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
