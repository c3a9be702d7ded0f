"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "metric_bootstrap_ci",
    "asr_rates",
    "asr_bootstrap_ci",
    "classification_metrics",
    "classification_cluster_bootstrap",
    "trials_all_pairs",
    "verification_eer_mindcf",
    "capped_trials",
    "verification_bootstrap",
    "embedding_covariance",
    "sliced_normality",
    "split_by_source",
    "group_kfold",
    "sample_groups",
    "duration_profile",
    "source_roundtrip",
    "shard_assignment",
    "shard_verify",
    "amplitude_contract",
    "stored_statistics",
    "log_merge_last_wins",
    "interval_metrics",
    "stream_log_merge",
)


def main() -> None:
    from utterset.queries import all_queries
    from utterset.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "utterset-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # start executor threads and Python workers before the first timing
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
