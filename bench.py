"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docspark.plans import QUERIES  # noqa: E402
from docspark.session import get_session  # noqa: E402

HEADLINE = [
    "fast_detect",
    "document_report",
    "chunk_report",
    "label_shares",
    "dedup_scoring",
    "cross_perplexity",
    "detector_evaluation",
    "word_ngrams",
    "extract_identity",
    "redact_everywhere",
    "identity_nodes",
    "identity_proximity",
    "redact_and_verify",
    "docx_redaction",
    "rewrite_text",
    "guarded_rewrite",
    "section_gate",
    "find_derived",
    "audit_uploads",
    "assemble_multipart",
    "number_duplicates",
    "status_distribution",
    "rate_limit",
    "request_log_rows",
    "extract_html_body",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = get_session(
        "docspark-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()
    timings = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
