"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
(optional, comma-separated, or ``all``) other queries to time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cartwise.session import build_session  # noqa: E402
from workload.spark_queries import QUERIES  # noqa: E402

HEADLINE = [
    "popularity_scores",
    "trending_scores",
    "trending_and_popular",
    "popular_purchases",
    "ratings_matrix_summed",
    "user_index",
    "rank_per_user",
    "topk_per_user",
    "recs_for_user",
    "tfidf_normalised",
    "item_similarity",
    "similar_items",
    "similar_items_later",
    "hybrid_scores",
    "cf_recommendations",
    "train_recommendations",
    "recommend_all_users_orders",
    "stream_ingest",
    "stream_popularity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("events", "part", "lineitem", "orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
