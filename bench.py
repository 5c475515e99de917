"""Time headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores,
``BENCH_ROUNDS`` the timed runs after one warm run (median is reported).
Building the stored tables is timed as queries of its own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchflow.plans import tables  # noqa: E402
from matchflow.plans.queries import QUERIES  # noqa: E402
from matchflow.session import build_session, local_master  # noqa: E402

HEADLINES = [
    "events_parsed", "significant_events", "dedup_first", "dedup_latest", "validate_strict", "quarantine_rows",
    "batch_outcomes", "round_metrics", "round_metrics_merged", "match_metrics", "match_summary", "round_enriched",
    "win_streaks", "player_stats", "player_round_stats", "team_match_stats", "match_timeline", "event_counts",
    "match_state", "replay_final_state", "features", "rule_prediction", "limited_prediction", "swing_flags", "brier",
    "calibration", "model_quality", "latest_prediction", "prediction_history_doc", "sequence_gaps", "late_events",
    "sequence_actions", "sliding_rate", "latency_slo", "slo_status", "stage_latency", "latency_histogram",
    "error_rate", "error_budget", "api_usage", "quota_usage", "live_matches", "match_details", "match_document",
    "team_form", "match_page", "integrity_missing", "system_summary",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        local_master(), "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {
        "build_events": timed(lambda: tables.events(spark, sf_dir)),
        "build_predictions": timed(lambda: tables.predictions(spark, sf_dir)),
    }
    wanted = os.environ.get("BENCH_QUERIES")
    for name in wanted.split(",") if wanted else HEADLINES:
        def run() -> None:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = statistics.median(timed(run) for _ in range(rounds))
    rows = tables.events(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()}, "sf": os.path.basename(sf_dir.rstrip("/")),
        "events": rows, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
