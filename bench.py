"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is executed completely (into a sink that discards rows) twice; the
faster run counts, so JVM warm-up is not measured.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "clean_categoricals", "feature_time", "feature_text_flags", "document_text_flags", "coords_imputed",
    "density_lookup", "corridor_congestion", "congested_corridors", "new_events_per_tick", "station_directory",
    "nearest_station", "recommendation", "dispatch_orders", "dispatch_capped_per_tick", "live_kpis",
    "median_duration_by_cause", "exact_medians_by_descent", "top_choices", "reference_tables",
    "eval_regression", "roc_auc", "f1_threshold_sweep", "folds_stratified", "fold_temporal",
    "target_encoding_oof", "text_vocabulary", "tfidf_vectors", "stream_congestion",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("roadpulse-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from roadpulse.plans import QUERIES

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
