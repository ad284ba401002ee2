"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   folder of the benchmark tables
    BENCH_CPUS   (default: all cores)             local cores
    BENCH_RUNS   (default 3)                      runs per query; the median counts
    BENCH_QUERIES                                 comma list of names, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidecrew import registry  # noqa: E402
from tidecrew.session import local_session  # noqa: E402

HEADLINE = (
    "impact_stats",
    "top_volunteers",
    "dashboard_stats",
    "recent_activities",
    "user_activity",
    "drive_overview",
    "monthly_stats",
    "top_organizers",
    "completed_buyers",
    "organiser_buyers",
    "drive_roster",
    "organiser_completed_totals",
    "drive_payroll",
    "drive_volunteer_names",
    "buyer_summary",
    "priced_catalog",
    "cart_total_badge",
    "purchase_history_view",
    "latest_feedback",
    "product_rating_summary",
    "search_recommendations_term",
    "training_features",
    "category_boost",
    "recommendations",
    "similar_users",
    "award_badges",
    "apply_purchases_stock",
    "checkout_carts",
    "decrement_stock",
    "donations_by_day",
)


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(cpus, "bench")
    queries = registry.queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        seconds[name] = round(statistics.median(run(queries[name], spark, folder) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("/sf", 1)[-1],
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
