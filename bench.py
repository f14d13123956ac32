"""Time the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from checks.compare import local_session  # noqa: E402

HEADLINES = (
    "hourly_keyword",
    "keyword_signal",
    "hashtags",
    "clean_posts",
    "quality_filter",
    "reject_report",
    "topic_match",
    "dedup_id_url",
    "first_query_wins",
    "top_hashtags",
    "query_rate",
    "pages_extract",
    "parquet_by_date",
    "hourly_bootstrap",
    "tfidf_vocab",
    "tfidf_score",
    "hourly_signals",
    "stream_hourly",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    # Start-up costs (code paths, Python workers) are paid on the smallest tables.
    warm_up = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_up):
        for name in ("clean_posts", "hourly_keyword"):
            QUERIES[name](spark, warm_up).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 2)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
