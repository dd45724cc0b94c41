"""Boards, lists and lookups with their parameters: sort fields, pages, optional filters.

An empty parameter means any. Every order ends in an id, so equal rows have a defined place. Columns that a function doesn't name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Board columns by weight; True: the greater value comes first.
RANKING = {"peak_sustained_tps": True, "p99_at_peak_ns": False, "spike_recovery_ns": False, "total_correctness": True}
# Names of sort fields and the columns that they mean.
SORT_FIELDS = {
    "rank": "rank", "peak_tps": "peak_sustained_tps", "peak_sustained_tps": "peak_sustained_tps", "p99": "p99_at_peak_ns", "p99_at_peak": "p99_at_peak_ns", "p99_ns_at_peak_tps": "p99_at_peak_ns",
    "spike_recovery": "spike_recovery_ns", "spike_recovery_ns": "spike_recovery_ns", "total_score": "total_correctness", "total_correctness": "total_correctness", "correctness": "total_correctness",
    "team_name": "team_name", "computed_at": "computed_at",
}
MOST_ROWS, ROWS, MOST_GROUPS, GROUPS = 500, 100, 200, 100


def by(name: str, descending: bool) -> Column:
    return F.desc(name) if descending else F.asc(name)


def board_order(field: str = "", direction: str = "") -> list[Column]:
    """Disqualified groups last, then the field (an unknown one is rank), in its own direction unless asc or desc is asked for, then
    what breaks ties: the other columns of the ranking, or the rank for columns outside it, and the id."""
    column = SORT_FIELDS.get(field.strip().lower().replace("-", "_"), "rank")
    asked = {"asc": False, "desc": True}.get(direction.strip().lower())
    descending = RANKING.get(column, column == "computed_at") if asked is None else asked
    ties = [by(c, d) for c, d in RANKING.items() if c != column] if column in RANKING else [F.asc("rank")] if column != "rank" else []
    return [F.asc("disqualified"), by(column, descending), *ties, F.asc("run_group_id")]


def ranked(scores: DataFrame, step_ns: int = 100_000) -> DataFrame:
    """The scores with their rank from 1 on. No task orders all rows: groups are counted by flag, peak and stretch of step_ns of p99, the
    counts are summed in order, and rows are ordered inside a stretch. Scores have no nulls in these columns."""
    keys = ["disqualified", "peak_sustained_tps", "_stretch"]
    cut = scores.withColumn("_stretch", F.col("p99_at_peak_ns") - F.pmod("p99_at_peak_ns", F.lit(step_ns)))
    before = Window.orderBy(F.asc("disqualified"), F.desc("peak_sustained_tps"), F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    steps = cut.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys).orderBy(*[by(c, d) for c, d in RANKING.items() if c != "peak_sustained_tps"], F.asc("run_group_id"))
    return cut.join(steps, keys).withColumn("rank", (F.col("_ahead") + F.row_number().over(inside)).cast("long")).select("rank", *scores.columns)


def page(rows: DataFrame, order: list[Column], limit: int = 0, offset: int = 0, most: int = MOST_ROWS, usual: int = ROWS) -> DataFrame:
    """Rows offset + 1 to offset + limit with their position and next_offset (null on the last page). A limit outside 1 to `most` is
    `usual`. One row more than asked for is taken to know whether there is another page; the windows see this page alone."""
    limit = limit if 0 < limit <= most else usual
    taken = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = taken.withColumn("position", F.row_number().over(Window.orderBy(*order)) + F.lit(offset).cast("long"))
    more = F.max("position").over(Window.partitionBy()) > offset + limit
    return numbered.withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("long"))).where(F.col("position") <= offset + limit)


def wanted(rows: DataFrame, equal: dict[str, str] | None = None, within: dict[str, list[str]] | None = None, search: str = "", searched: tuple[str, ...] = ()) -> DataFrame:
    """Rows equal to each given text that is not empty, in each list that is not empty, and with the search text in one of the
    searched columns, whatever the case (% and _ stand for any text and any character; a null column holds nothing)."""
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value) if value else rows
    for column, values in (within or {}).items():
        rows = rows.where(F.col(column).isin(*values)) if values else rows
    if search:
        found = F.lit(False)
        for column in searched:
            found = found | F.coalesce(F.col(column).ilike(f"%{search}%"), F.lit(False))
        rows = rows.where(found)
    return rows


def leaderboard(scores: DataFrame, runs: DataFrame, scenarios: DataFrame, run_group_id: str = "", submission_id: str = "", contestant_id: str = "", team_name: str = "", scenario: str = "", sort: str = "", direction: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the board. Ranks are those among all groups, filters leave some out; scenario: the name of one that the group ran."""
    rows = wanted(ranked(scores), {"run_group_id": run_group_id, "submission_id": submission_id, "contestant_id": contestant_id}, search=team_name, searched=("team_name",))
    if scenario:
        ran = runs.join(scenarios.where(F.col("name") == scenario).select("scenario_id"), "scenario_id", "left_semi")
        rows = rows.join(ran.select("run_group_id"), "run_group_id", "left_semi")
    return page(rows, board_order(sort, direction), limit, offset)


def run_groups(groups: DataFrame, teams: DataFrame, contestant_id: str = "", submission_ids: list[str] | None = None, search: str = "", limit: int = 0) -> DataFrame:
    """Run groups with their team's name ('' without one), newest first, of a contestant, of listed submissions, and with the
    search text in contestant or team; at most limit (1 to 200, else 100). teams: submission_id, team_name."""
    rows = wanted(groups, {"contestant_id": contestant_id}, {"submission_id": submission_ids or []}).join(teams, "submission_id", "left").withColumn("team_name", F.coalesce("team_name", F.lit("")))
    rows = wanted(rows, search=search, searched=("contestant_id", "team_name"))
    return rows.orderBy(F.desc("created_at"), "run_group_id").limit(limit if 0 < limit <= MOST_GROUPS else GROUPS)


def lookup(rows: DataFrame, key: str, *ids: str) -> DataFrame:
    """The rows with one of these ids; the test reaches the scan. No ids: no rows."""
    return rows.where(F.col(key).isin(*ids)) if ids else rows.limit(0)
