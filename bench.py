"""Time headline queries at $BENCH_SF_DIR and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemeter.catalog import load  # noqa: E402
from tidemeter.session import build_session  # noqa: E402

HEADLINE = (
    "weekly_model_change", "usage_summary", "totals_by_day", "period_model_totals", "period_model_composition",
    "wide_month_table", "model_registry", "hourly_by_day_model", "weekday_hour_matrix", "activity_matrix",
    "top_projects", "top_sessions", "project_model_totals", "relation_edges", "top_projects_composed",
    "project_catalogue", "flow_slice", "distribution_statistics", "session_replay", "running_max_turns",
    "change_attribution", "interval_comparison", "peak_month_profile", "evidence_projects", "running_totals",
    "running_distinct", "trend_with_gaps", "leader_relays", "seasons_by_month", "personal_records",
    "work_modes", "field_coverage", "snapshot_identity", "milestone_progress", "milestone_unlock_days",
    "matrix_milestones", "claude_records", "gemini_records", "codex_records", "session_titles",
    "pseudonym_table", "streamed_day_totals",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    only = sys.argv[1:]
    catalog["totals_by_day"](spark, root).count()
    times = {}
    for name in only or HEADLINE:
        # Nothing persisted by an earlier query may help the next one.
        spark.catalog.clearCache()
        began = time.perf_counter()
        catalog[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
