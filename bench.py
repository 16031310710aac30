"""Times the headline queries on one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from evalspark.registry import QUERIES
from evalspark.session import local_session

HEADLINE = [
    "metrics_binary", "metrics_multiclass", "stratified_split", "stratified_folds", "stage2_sample", "shots_k",
    "score_rows", "resume_scoring", "roc_auc", "roc_auc_ties", "usage_stats", "exact_percentiles", "tfidf_weights",
    "tfidf_bigrams", "nb_predict", "impute", "rare_onehot", "cell_representatives", "rule_results", "leaderboard_wide",
    "incremental_scoring_stream", "svd_features", "kmeans_best", "baseline_nb", "baseline_svm", "baseline_gbt",
    "baseline_text_lr", "baseline_lr", "oof_scores", "stack", "evaluate",
]

LONG = 60.0  # seconds after which a query is not run again; the others report the median of BENCH_RUNS runs


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "evalspark-bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # starts the executor threads
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if sum(times) > LONG:
                break
        seconds[name] = round(statistics.median(times), 3)
        spark.catalog.clearCache()
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
