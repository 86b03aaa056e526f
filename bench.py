"""Headline queries, wall clock. Prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. Every query runs
twice over its whole tables into a discarding sink; the better run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload import QUERIES  # noqa: E402

HEADLINE = [
    "policy_monitor", "policy_monitor_events", "policy_monitor_orders", "violations", "first_violation",
    "ltl_nested", "policy_replay_eval", "knn_vote", "similarity_join", "nli_rerank_vote", "hybrid_vote",
    "score_all_modes", "soft_knn", "confusion_metrics", "calibrate_thresholds", "similarity_stats",
    "pairwise_self_join", "greedy_dedup", "leader_clusters", "mmr_balanced", "hard_mining", "sentences",
    "relevant_chunks", "score_messages", "judge_parse", "stream_monitor",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    messages = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
        "per_message_sec": {q: round(times[q] / messages, 6) for q in ("knn_vote", "nli_rerank_vote", "hybrid_vote")}}))
    spark.stop()


if __name__ == "__main__":
    main()
