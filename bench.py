"""Wall time of the headline queries: one JSON line.  BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the cores.

Headline queries are timed after a first run, op* and the pipeline in their only run."""

from __future__ import annotations

import importlib
import json
import os
import statistics
import sys
import time

HEADLINE = ["chunk_sliding", "flicker_features", "kept_chunks", "topk_chunks", "video_summary", "baseline_stats", "robust_scale", "percentile_rank_signal", "masked_scores", "threshold_calibration", "top_features", "auc_roc", "best_threshold", "wer_pairs", "verdict_metrics", "report_assemble", "resume_antijoin", "stage_rollup", "greedy_split", "repetition_collapse"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    names = [n for n in HEADLINE if n in queries] + [n for n in queries if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2")) if name in HEADLINE else 1):  # the first warms up
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
