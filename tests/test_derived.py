"""Rollups with silent and restarted shards, minute calendars, nested answers, layouts that prune, joins without a shuffle, and folds."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from wavegrade.operators import alerts, intime, nested, rollup, violations
from wavegrade.operators.feeds import folder
from wavegrade.sources import io

S = 1_000_000_000
COUNTS = "session_id string, wave long, shard long, run long, second_ns long, bucket_hi long, n long, answered long"


def counts(spark, rows):
    return spark.createDataFrame([("s", 0, *r, r[-1]) for r in rows], COUNTS)


def test_a_silent_shard_is_carried_and_a_restart_is_whole(spark):
    # Shard 1: 3 and 2 more values, silent, then begins anew with one; shard 2 comes in the second second.
    rows = [(1, 0, 1, 100, 3), (1, 0, 2, 100, 1), (1, 0, 2, 200, 1), (1, 1, 4, 200, 1), (2, 0, 2, 300, 5), (2, 0, 3, 300, 1)]
    p = rollup.partials(counts(spark, rows), ["answered"])
    assert {(r.shard, r.second_ns): r.cum for r in p.collect()} == {(1, 1): {100: 3}, (1, 2): {100: 4, 200: 1}, (1, 4): {200: 1}, (2, 2): {300: 5}, (2, 3): {300: 6}}
    assert {(r.shard, r.second_ns): r.slice for r in rollup.slices(p).collect()} == {(1, 1): {100: 3}, (1, 2): {100: 1, 200: 1}, (1, 4): {200: 1}, (2, 2): {300: 5}, (2, 3): {300: 1}}
    held = {(r.shard, r.second_ns): (r.cum, r.fresh) for r in rollup.carried(p).collect()}
    assert held == {(1, 1): ({100: 3}, True), (1, 2): ({100: 4, 200: 1}, True), (1, 3): ({100: 4, 200: 1}, False), (1, 4): ({200: 1}, True), (2, 2): ({300: 5}, True), (2, 3): ({300: 6}, True), (2, 4): ({300: 6}, False)}
    found = {r.second_ns: (r.answered, r.p50, r.cum) for r in rollup.rolled(p, ["answered"], {"p50": "0.5"}).collect()}
    assert found == {1: (3, 100, {100: 3}), 2: (7, 300, {100: 4, 200: 1, 300: 5}), 3: (1, 300, {100: 4, 200: 1, 300: 6}), 4: (1, 200, {200: 1, 300: 6})}


def test_a_second_without_new_values(spark):
    p = spark.createDataFrame([("s", 0, 1, 1, {5: 2}, 2), ("s", 0, 1, 2, {5: 2}, 0)], "session_id string, wave long, shard long, second_ns long, cum map<bigint,bigint>, answered long")
    assert [(r.second_ns, r.p99, r.cum) for r in rollup.rolled(p, ["answered"], {"p99": "0.99"}).orderBy("second_ns").collect()] == [(1, 5, {5: 2}), (2, 0, {5: 2})]
    assert rollup.rolled(p.limit(0), ["answered"], {"p99": "0.99"}).count() == 0


def brute_rises(samples, window):
    """By label and minute: the increase over the window, by plain steps between samples in order."""
    out = {}
    for label in {s[0] for s in samples}:
        mine = sorted((s[1:] for s in samples if s[0] == label), key=lambda s: s)
        last = None
        for at, _, v in mine:
            step = 0 if last is None else v if v < last else v - last
            last = v
            for k in range(window):
                if at // 60 + k <= mine[-1][0] // 60:
                    out[label, at // 60 + k] = out.get((label, at // 60 + k), 0) + step
    return out


@pytest.mark.parametrize("seed,window", [(1, 5), (2, 1), (3, 30)])
def test_increase_across_minutes_restarts_and_gaps(spark, seed, window):
    rng, rows = random.Random(seed), []
    for label in "ab":
        at = value = 0
        for k in range(150):
            at += rng.choice((0, 3, 20, 61, 500))
            value = rng.randrange(4) if rng.random() < 0.1 else value + rng.randrange(6)
            rows.append((label, at, k, value))
    df = spark.createDataFrame(rows, "label string, at_s long, k long, value long")
    want = brute_rises(rows, window)
    found = {(r.label, r.minute): r.increase for r in alerts.increase(df, ["label"], window, order=("k",)).collect()}
    assert found == want
    dense = {(r.label, r.minute): r.increase for r in alerts.increase(df, ["label"], window, 0, order=("k",)).collect()}
    span = {label: [r[1] // 60 for r in rows if r[0] == label] for label in "ab"}
    assert dense == {(label, m): want.get((label, m), 0) for label in "ab" for m in range(min(span[label]), max(span[label]) + 1)}


def test_alerts_hold_and_absence(spark):
    rise = spark.createDataFrame([("a", m, 1) for m in (1, 2, 3, 7, 8)] + [("a", 4, 0), ("b", 5, 2)], "label string, minute long, increase long")
    assert [tuple(r) for r in alerts.held(rise, ["label"], 2).collect()] == [("a", 1, 3, 3)]
    samples = spark.createDataFrame([("a", 0, 1), ("a", 60 * 10, 2), ("a", 60 * 13, 3), ("b", None, 1), ("b", 60, None)], "label string, at_s long, value long")
    assert sorted(tuple(r) for r in alerts.absent(samples, ["label"], 4, 5, until=17).collect()) == [("a", 4, 9, 9), ("a", 17, 17, None)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    sent = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 3).alias("session_id"), F.col("id").cast("string").alias("order_id"), F.lit(0).cast("long").alias("t0"), F.lit(False).alias("timed_out"))
    acked = sent.where("cast(order_id as int) % 2 = 0").select("session_id", "order_id", F.lit("F").alias("exec_type"), F.lit(1).cast("long").alias("t3"), F.lit(2).cast("long").alias("t7"), F.lit(1).cast("long").alias("fill_qty"), F.lit(1).cast("long").alias("fill_price"))
    found = intime.outcomes(io.write_bucketed(sent, 4), io.write_bucketed(acked, 4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = plan[re.search(r"SortMergeJoin|ShuffledHashJoin", plan).start():]
    assert "Exchange" not in join and "Bucketed: true" in join
    assert {(r.outcome, r.n) for r in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {("matched", 150), ("gap", 150)}


def test_a_scan_reads_the_hours_and_partitions_it_needs(spark):
    ms = 1_700_000_000_000
    h = f"{ms:012x}"
    sid = f"{h[:8]}-{h[8:]}-7abc-8000-000000000001"
    assert io.session_start_ms(sid) == ms
    assert [io.session_start_ms(x) for x in ("s3", sid.replace("-7", "-4"), "0" * 12 + "7" + "0" * 19, "")] == [None] * 4
    start = ms * 1_000_000
    rows = [(sid, str(k), start + d * S) for k, d in enumerate((-7200, -61, -60, 0, 10, 3600, 7200, 7201, 90000))] + [("other", "99", start)]
    path = folder(spark)
    io.write_events(spark.createDataFrame(rows, "session_id string, order_id string, t0 long"), path, 4)
    scan = io.scan_layout(spark, path, sid, start + 7200 * S, 4)
    assert sorted(int(r.order_id) for r in scan.collect()) == [2, 3, 4, 5, 6]
    assert sorted(int(r.order_id) for r in io.scan_layout(spark, path, "other", start, 4).collect()) == [99]
    part = io.scan_layout(spark, path, sid, start + 7200 * S, 4, band=1, width=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = part._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[(.*?), PushedFilters", plan, re.S).group(1)
    assert "event_hour" in filters and "part" in filters
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(part)) < len(files(spark.read.parquet(path)))
    assert {r.part for r in part.collect()} <= {2, 3}


RUNS = "run_group_id string, created_at long, session_id string, scenario_id string, status string"


def test_nested_answers(spark):
    runs = spark.createDataFrame([("g1", 1, "s1", "spike", "running"), ("g1", 1, "s2", "ramp", "completed"), ("g2", 2, "s3", "spike", "failed"), ("g3", 3, "s4", "ramp", "queued"), ("g3", 3, "s5", "spike", "completed")], RUNS)
    scenarios = spark.createDataFrame([("spike", 2), ("ramp", 3)], "scenario_id string, sort_order int")
    teams = spark.createDataFrame([("g1", "one")], "run_group_id string, team_name string")
    rows = nested.active_runs(runs, scenarios, teams).collect()
    assert [(r.run_group_id, r.team_name, [s.session_id for s in r.sessions]) for r in rows] == [("g3", "", ["s5", "s4"]), ("g1", "one", ["s1", "s2"])]
    assert [len(r.sessions) for r in nested.active_runs(runs, scenarios, teams, 3).collect()] == [2, 1]
    scores = spark.createDataFrame([("g1", 7)], "run_group_id string, peak long")
    progress = spark.createDataFrame([("s1", 0.5, 1, 2)], "session_id string, correctness_score double, valid_fills long, total_fills long")
    points = spark.createDataFrame([("s1", 1, 9), ("s1", 0, 8)], "session_id string, wave long, tps long")
    found = {r.run_group_id: r for r in nested.run_detail(runs, scenarios, scores, progress, points, spark.createDataFrame([("g1", "lost", 4)], "run_group_id string, kind string, n long")).collect()}
    assert found["g1"].score.peak == 7 and [(v.kind, v.n) for v in found["g1"].violations] == [("lost", 4)]
    assert [(s.session_id, s.valid_fills, [(p.wave, p.tps) for p in s.timeline]) for s in found["g1"].sessions] == [("s1", 1, [(0, 8), (1, 9)]), ("s2", None, [])]
    assert found["g2"].score is None and found["g2"].violations == []


def test_a_status_that_goes_back_has_no_effect(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "ready", 3), ("a", "uploaded", 1), ("a", "building", 4), ("a", "paused", 9), ("b", "failed", 2), ("b", "ready", 3), ("c", "sbom_ready", 1), ("c", "scanned", 2), ("c", None, 3), (None, "ready", 1), ("b", "uploaded", 1)]
    df = spark.createDataFrame([(k, s, t + dt.timedelta(seconds=n)) for k, s, n in rows], "entity_id string, status string, at timestamp")
    for order in ("at", "status"):
        found = {r.entity_id: (r.status, r.since.second, r.ignored) for r in io.fold_submissions(df.orderBy(order)).collect()}
        assert found == {"a": ("ready", 3, 1), "b": ("failed", 2, 1), "c": ("scanned", 2, 0)}


def test_violations_that_need_no_book(spark):
    sent = spark.createDataFrame([("s", o, 10, k, lost) for o, k, lost in (("1", "NEW", False), ("2", "NEW", False), ("3", "NEW", False), ("4", "CANCEL", True), ("5", "NEW", True), ("6", "NEW", False), ("7", "NEW", False))], "session_id string, order_id string, qty long, payload_type string, timed_out boolean")
    ms = 1_000_000
    ack = lambda o, ip, seq, t3, t7, e="0", q=0: ("s", o, ip, 1, seq, t3, t7, e, q, 7)
    rows = [
        ack("1", 1, 10, 5 * ms, 20 * ms, "1", 6), ack("1", 1, 10, 5 * ms, 21 * ms, "F", 5), ack("1", 1, 10, 5 * ms, 21 * ms, "F", 5),  # 11 of 10; redelivered
        ack("2", 1, 20, 6 * ms, 19 * ms),  # before order 1 of its flow, so order 1 is out of sequence
        ack("3", 2, 5, 1 * ms, 30 * ms),  # after later orders of another flow
        ack("7", 3, 1, 2 * ms, 1 * ms),  # answered before it came: unusable, so lost
        ack("nobody", 1, 40, 1 * ms, 2 * ms, "F", 3),
    ]
    acked = spark.createDataFrame(rows, "session_id string, order_id string, src_ip long, src_port long, tcp_seq long, t3 long, t7 long, exec_type string, fill_qty long, fill_price long")
    found = violations.violations(sent, acked, parts=3)
    assert sorted((r.order_id, r["class"], r.detail) for r in found.collect()) == [("1", "overfill", "5"), ("1", "time", "flow"), ("3", "time", "cross"), ("4", "lost_cancel", ""), ("5", "lost_order", ""), ("7", "lost_order", "")]
    assert [tuple(r) for r in violations.phantoms(sent, acked).collect()] == [("s", 1)]
    assert [tuple(r) for r in violations.counters(found, ["session_id"]).collect()] == [("s", 1, 2, 2, 1, 6)]
    assert {tuple(r) for r in violations.class_counts(found).collect()} == {("s", "overfill", 1), ("s", "time", 2), ("s", "lost_order", 2), ("s", "lost_cancel", 1)}
    assert [(r["class"], r.n, r.total) for r in violations.summary(found).collect()] == [("lost_order", 2, 6), ("time", 2, 6), ("lost_cancel", 1, 6), ("overfill", 1, 6)]
    assert violations.examples(found, 1).count() == 4
    assert violations.violations(sent.limit(0), acked.limit(0)).count() == 0
