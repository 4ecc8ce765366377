"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

``analyze_learned`` and ``analyze_given_clusters`` run the whole chain from the
tables. The reports after them read the settled tables of the second one, as a
user would. One warm-up round on the smallest data set starts the Python
workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from moodloom.checks import QUERIES
    from moodloom.checks.registry import stages
    from moodloom.plans.pipeline import analyze
    from moodloom.sources import tables

    def learned(spark, sf):
        a = analyze(
            tables.playlists(spark, sf), tables.items(spark, sf), tables.tracks(spark, sf),
            restarts=1, max_iter=5,
        )
        return a.summary

    def planted(spark, sf):
        return stages(spark, sf).tracks

    headline = {
        "analyze_learned": learned,
        "analyze_given_clusters": planted,
        **{
            n: QUERIES[n]
            for n in (
                "I2_flatten_items",
                "I4_keep_first_overall",
                "F5_vocabulary_documents",
                "F10_robust_scale",
                "K3_silhouette",
                "K7_top_tags",
                "A3_flags",
                "A8_anomaly_listing",
                "M1_summary",
                "M3_mood_distribution",
                "M4_compare",
                "M14_digest",
                "C1_changed_playlists",
                "C4_insert_only",
                "R7_recommendations",
                "I15_analysis_export",
            )
        },
    }

    def run(fn, sf):
        start = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for fn in headline.values():
            run(fn, small)
    times = {}
    only = set(sys.argv[1:])
    for name, fn in headline.items():
        if only and name not in only:
            continue
        times[name] = run(fn, sf_dir)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
