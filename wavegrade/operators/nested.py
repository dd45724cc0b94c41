"""Answers that nest: active runs and a run group's detail, as rows with sorted arrays of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """One row for each key, its rows as an array of structs in the order of the columns named first."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def active_runs(runs: DataFrame, scenarios: DataFrame, teams: DataFrame, limit: int = 500) -> DataFrame:
    """Groups with a session that has not ended, newest first, with all their sessions by scenario; at most limit sessions.
    runs: run_group_id, created_at, session_id, scenario_id, status; teams: run_group_id, team_name (none: '')."""
    open_groups = runs.where(~F.col("status").isin("completed", "failed")).select("run_group_id").distinct()
    rows = runs.join(open_groups, "run_group_id", "left_semi").join(scenarios.select("scenario_id", "sort_order"), "scenario_id")
    rows = rows.join(teams, "run_group_id", "left").select("run_group_id", "created_at", F.coalesce("team_name", F.lit("")).alias("team_name"), "sort_order", "scenario_id", "session_id", "status")
    top = rows.orderBy(F.desc("created_at"), "sort_order", "scenario_id", "session_id").limit(limit)
    return gathered(top, ["run_group_id", "created_at", "team_name"], ["sort_order", "scenario_id", "session_id"], "sessions").orderBy(F.desc("created_at"), "run_group_id")


def run_detail(runs: DataFrame, scenarios: DataFrame, scores: DataFrame, progress: DataFrame, points: DataFrame, violations: DataFrame) -> DataFrame:
    """A row for each run group: score (null if there is none), sessions by scenario with their progress (null if not graded) and
    timeline by wave, and counts of violations by class. A group without sessions or violations has empty arrays.
    progress: session_id, correctness_score, valid_fills, total_fills; points: session_id, wave and measures; violations: run_group_id, kind, n."""
    lines = gathered(points, ["session_id"], ["wave"], "timeline")
    empty = F.array().cast(lines.schema["timeline"].dataType)
    s = runs.join(scenarios.select("scenario_id", "sort_order"), "scenario_id").join(progress, "session_id", "left").join(lines, "session_id", "left")
    s = s.select("run_group_id", "sort_order", "scenario_id", "session_id", "status", "correctness_score", "valid_fills", "total_fills", F.coalesce("timeline", empty).alias("timeline"))
    sessions = gathered(s, ["run_group_id"], ["sort_order", "scenario_id", "session_id"], "sessions")
    counts = gathered(violations, ["run_group_id"], ["kind"], "violations")
    rest = [c for c in scores.columns if c != "run_group_id"]
    score = scores.select("run_group_id", F.struct(*rest).alias("score"))
    found = sessions.join(score, "run_group_id", "left").join(counts, "run_group_id", "left")
    return found.withColumn("violations", F.coalesce("violations", F.array().cast(counts.schema["violations"].dataType)))
