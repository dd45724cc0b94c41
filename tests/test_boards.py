"""Sort fields, pages, filters, declarations, ids, matches and doubts on small rows."""

import random

import pytest

from wavegrade.operators import admission, boards

SCORES = "run_group_id string, team_name string, peak_sustained_tps long, p99_at_peak_ns long, spike_recovery_ns long, total_correctness double, disqualified boolean, computed_at long"


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = [(f"g{n:03}", rng.choice(["a", "b", "Ab"]), rng.randrange(3) * 10, rng.randrange(4) * 60_000, rng.randrange(2), rng.randrange(3) / 2, rng.random() < 0.2, rng.randrange(9)) for n in range(300)]
    return spark.createDataFrame(rows, SCORES)


def plain(rows, field, down):
    order = {"peak_sustained_tps": -1, "p99_at_peak_ns": 1, "spike_recovery_ns": 1, "total_correctness": -1}
    value = lambda r: r[field] if not isinstance(r[field], str) else [ord(c) for c in r[field]]
    rest = sorted(rows, key=lambda r: (*[s * r[c] for c, s in order.items() if c != field], r["run_group_id"]) if field in order else (r["rank"], r["run_group_id"]))
    rest.sort(key=value, reverse=down)
    rest.sort(key=lambda r: r["disqualified"])
    return [r["run_group_id"] for r in rest]


def test_ranks_equal_one_sort_whatever_the_stretch(scores):
    rows = scores.collect()
    want = sorted(rows, key=lambda r: (r["disqualified"], -r["peak_sustained_tps"], r["p99_at_peak_ns"], r["spike_recovery_ns"], -r["total_correctness"], r["run_group_id"]))
    for step in (1, 100_000, 10**9):
        assert {r["run_group_id"]: r["rank"] for r in boards.ranked(scores, step).collect()} == {r["run_group_id"]: n + 1 for n, r in enumerate(want)}


@pytest.mark.parametrize("field, direction, column, down", [("Peak-TPS ", "", "peak_sustained_tps", True), ("p99", "DESC", "p99_at_peak_ns", True), ("correctness", "asc", "total_correctness", False), ("team_name", "", "team_name", False), ("computed_at", "", "computed_at", True), ("nothing", "sideways", "rank", False)])
def test_sort_fields(scores, field, direction, column, down):
    rows = boards.ranked(scores)
    got = [r["run_group_id"] for r in rows.orderBy(*boards.board_order(field, direction)).collect()]
    # Python's sort keeps equal rows in order in both directions, as the ties ask for.
    assert got == plain(rows.collect(), column, down)


def test_pages_meet_and_end(scores, capsys):
    rows, order = boards.ranked(scores), boards.board_order()
    first, second, last = (sorted(boards.page(rows, order, 120, o).collect(), key=lambda r: r["position"]) for o in (0, 120, 240))
    assert [r["rank"] for r in first + second + last] == list(range(1, 301)) == [r["position"] for r in first + second + last]
    assert [{r["next_offset"] for r in p} for p in (first, second, last)] == [{120}, {240}, {None}]
    assert len(boards.page(rows, order, 501).collect()) == len(boards.page(rows, order).collect()) == 100
    assert {r["next_offset"] for r in boards.page(rows, order, 300).collect()} == {None} and not boards.page(rows, order, 10, 300).collect()
    boards.page(rows, order, 120, 120).explain()
    assert "TakeOrderedAndProject" in (plan := capsys.readouterr().out) and "rangepartitioning" not in plan


def test_filters_search_and_lookups(spark, scores):
    ids = lambda df: sorted(r["run_group_id"] for r in df.collect())
    rows = scores.collect()
    assert ids(boards.wanted(scores, {"team_name": ""}, {"run_group_id": []})) == ids(scores)
    assert ids(boards.wanted(scores, search="aB", searched=("team_name",))) == sorted(r["run_group_id"] for r in rows if r["team_name"] == "Ab")
    assert ids(boards.wanted(scores, {"team_name": "a"}, {"run_group_id": ["g001", "g002", "g003"]})) == sorted(r["run_group_id"] for r in rows[1:4] if r["team_name"] == "a")
    assert ids(boards.lookup(scores, "run_group_id", "g007", "zzz")) == ["g007"] and not boards.lookup(scores, "run_group_id").collect()
    groups = spark.createDataFrame([("g1", "s1", "c1", 5), ("g2", "s2", "c2", 9), ("g3", "s3", None, 9), ("g4", None, "Xc", 1)], "run_group_id string, submission_id string, contestant_id string, created_at long")
    teams = spark.createDataFrame([("s1", "Cats"), ("s2", None)], "submission_id string, team_name string")
    listed = lambda **k: [(r["run_group_id"], r["team_name"]) for r in boards.run_groups(groups, teams, **k).collect()]
    assert listed() == [("g2", ""), ("g3", ""), ("g1", "Cats"), ("g4", "")] and listed(limit=1) == [("g2", "")]
    assert listed(search="C") == [("g2", ""), ("g1", "Cats"), ("g4", "")] and listed(search="ats") == [("g1", "Cats")] and listed(submission_ids=["s3"], contestant_id="") == [("g3", "")]


def test_declarations(spark):
    told = {" fix ,rest": (["FIX", "REST"], ""), "ALL": (["FIX", "REST", "WS"], ""), "\tall\n": (["FIX", "REST", "WS"], ""), "WS,FIX": (["WS", "FIX"], ""), "FIX,ALL": (None, "invalid"), "fix,FIX,tcp": (None, "duplicate"), "tcp,fix,fix": (None, "invalid"), "": (None, "invalid"), "FIX,": (None, "invalid"), None: (None, "invalid")}
    rows = admission.protocols(spark.createDataFrame([(d,) for d in told], "declared string")).collect()
    assert {r["declared"]: (r["protocols"], r["problem"]) for r in rows} == told


def test_ids_matches_and_doubts(spark):
    ids = spark.createDataFrame([("s", x) for x in ("a" * 64, "a" * 65, "é" * 32, "é" * 33, "", None)], "session_id string, id string")
    assert [tuple(r) for r in admission.admitted(ids, "id", ["session_id"]).collect()] == [("s", 2, 2, 2)]
    messages = [("s", "1", "request", 5, False), ("s", "1", "request", 7, True), ("s", "1", "response", 9, False), ("s", "1", "response", 30, True), ("s", "2", "request", 1, False), ("s", "3", "response", 1, False), ("s", "4", "request", 2, None), ("s", "4", "response", 2, None), ("s", "", "request", 1, False), ("s", "", "response", 2, False)]
    found = admission.matched(spark.createDataFrame(messages, "session_id string, cl_ord_id string, class string, at_ns long, reordered boolean")).collect()
    assert sorted(tuple(r)[1:] for r in found) == [("1", 4, 1, True), ("4", 0, 0, False)]
    counts = [("even", 1, 0, 1000, 1000, 10), ("late", 1, 1, 1000, 1000, 0), ("gaps", 5, 5, 100, 98, 2), ("none", 0, 0, 0, 0, 0), ("all", 0, 0, 0, 0, 3)]
    doubts = admission.taint(spark.createDataFrame(counts, "session_id string, late long, anomalies long, applied long, scored long, gaps long")).collect()
    assert {r["session_id"]: (r["tainted"], r["reason"][:52]) for r in doubts} == {"even": (False, ""), "late": (True, "t7 stream unreliable: 1 late + 1 anomalous of 1000 o"), "gaps": (True, "capture lost the responses for 2 of 100 orders (2.0%"), "none": (False, ""), "all": (True, "capture lost the responses for 3 of 3 orders (100.0%")}
