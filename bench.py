"""Headline queries, timed end to end; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from postlens.queries import QUERIES
from postlens.session import local_session

HEADLINE = [
    "salary_bands", "cosine_to_profile", "content_dedup", "clean_text", "normalize_postings", "detect_signals",
    "score_postings", "upsert_merge", "report_sections", "email_top_n", "er_components", "pipeline_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["title_core"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
