"""Time the headline queries: prints one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "resume_roles",
    "resume_bullets",
    "jd_canonical",
    "style_profile",
    "tokens",
    "readability",
    "pii_flags",
    "corpus_skills",
    "skill_aggregate",
    "chunk_dedup",
    "topk_chunks",
    "knn_cosine",
    "retrieve_context",
    "substring_coverage",
    "token_coverage",
    "unsupported",
    "banned_claims",
    "evaluate_report",
    "validate_issues",
    "embedding_docs",
    "render_lines",
    "latest_status",
    "stream_upsert",
]


def main() -> None:
    from matchloom.plans.catalog import QUERIES
    from matchloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
