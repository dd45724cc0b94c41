"""Sinks across restarts, joins in time at their edges, order and jitter over ranges that cut sessions, scoring on the wave grid."""

import random

import pytest
from pyspark.sql import functions as F

from wavegrade.operators import feeds, intime, ordering
from wavegrade.plans import catalog
from wavegrade.sources import io
from wavegrade.streaming import sinks

SF = "/root/testdata/sf0.001"
ACKED = "session_id string, order_id string, src_ip long, src_port long, tcp_seq long, t3 long, t7 long"


def answers(n, seed, sessions=2, flows=3):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(sessions)}", str(k), rng.randrange(flows), 50000, k * 100, rng.randrange(60), rng.randrange(40)) for k in range(n)]


def brute_order(rows):
    out = {}
    for s, ip in {(r[0], r[2]) for r in rows}:
        top = None
        for r in sorted((r for r in rows if r[0] == s and r[2] == ip), key=lambda r: (r[4], int(r[1]))):
            top = r[5] if top is None else max(top, r[5])
            out[s, r[1]] = top
    return out


@pytest.mark.parametrize("seed,flows", [(1, 3), (2, 1), (3, 2), (4, 40)])
def test_order_and_jitter_over_ranges(spark, seed, flows):
    rows = answers(160, seed, flows=flows)
    df, eff = spark.createDataFrame(rows, ACKED), brute_order(rows)
    arrival = lambda r: (eff[r[0], r[1]], r[2], r[3], r[4], int(r[1]))
    ranged = ordering.ranged(ordering.effective(df), ordering.ANSWERED, 9)
    assert ranged.groupBy("session_id").agg(F.count_distinct("part").alias("n")).where("n >= 4").count() == 2
    places, other = {}, {}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        places |= {(s, r[1]): k + 1 for k, r in enumerate(sorted(mine, key=arrival))}
        steps = sorted(mine, key=lambda r: (r[6], *arrival(r)))
        other |= {(s, a[1]): max((b[5] for b in steps[:k] if b[2] != a[2]), default=None) for k, a in enumerate(steps)}
    assert {(r.session_id, r.order_id): r.nth for r in ordering.replay_order(df, 9).collect()} == places
    assert {(r.session_id, r.order_id): r.other_t3 for r in ordering.cross_flow(df, 9).collect()} == other


def test_predicate_at_the_allowed_gap(spark):
    # Orders of one flow before one of another: gaps of 300, 800 and -100 us; exactly the allowed gap is no violation.
    rows = [(s, "1", 1, 1, 1, t, 1) for s, t in (("a", 1_300_000), ("b", 1_800_000), ("c", 900_000), ("d", 1_500_000))] + [(s, "2", 2, 1, 1, 1_000_000, 2) for s in "abcd"]
    found = {r.session_id: (r.inversion, r.jitter_ns, r.violation) for r in ordering.jitter(spark.createDataFrame(rows, ACKED)).where("order_id = '2'").collect()}
    assert found == {"a": (True, 300_000, False), "b": (True, 800_000, True), "c": (False, 0, False), "d": (True, 500_000, False)}


def test_promotion_behind_the_head_of_a_line(spark):
    rows = [("s", "1", 1, 1, 10, 100, 0), ("s", "2", 1, 1, 20, 40, 0), ("s", "3", 1, 1, 30, 120, 0), ("s", "4", 2, 1, 5, 100, 0)]
    found = {r.order_id: (r.eff_t3, r.nth) for r in ordering.replay_order(spark.createDataFrame(rows, ACKED)).collect()}
    assert found == {"1": (100, 1), "2": (100, 2), "4": (100, 3), "3": (120, 4)}


def test_answers_at_the_edge_of_the_window(spark):
    ms = 1_000_000
    sent = spark.createDataFrame([("s", o, 1000 * ms, o == "lost") for o in ("at499", "at501", "edge", "early", "lost", "gap", "twice")], "session_id string, order_id string, t0 long, timed_out boolean")
    fill = lambda o, t, q=5: ("s", o, "F" if q else "0", t, t + 1, q, 7)
    rows = [fill("at499", 1499 * ms), fill("at501", 1501 * ms), fill("edge", 1500 * ms), fill("early", 999 * ms), fill("nobody", 1000 * ms, 0), fill("twice", 1001 * ms), fill("twice", 1001 * ms), fill("twice", 1600 * ms)]
    acked = spark.createDataFrame(rows, "session_id string, order_id string, exec_type string, t3 long, t7 long, fill_qty long, fill_price long")
    found = sorted((r.order_id, r.outcome, r.n_acks, r.filled) for r in intime.outcomes(sent, acked).collect())
    assert found == sorted([("at499", "matched", 1, 5), ("at501", "gap", 0, 0), ("at501", "phantom", 1, 5), ("edge", "matched", 1, 5), ("early", "gap", 0, 0), ("early", "phantom", 1, 5), ("lost", "lost", 0, 0), ("gap", "gap", 0, 0), ("nobody", "unsent", 1, 0), ("twice", "matched", 1, 5), ("twice", "phantom", 1, 5)])
    assert ("early", "matched") in {(r.order_id, r.outcome) for r in intime.outcomes(sent, acked, skew_ns=2 * ms).collect()}


def failing(sink, at):
    """The sink, that fails once after the batch number at is written and before Spark learns of it."""
    left = [at]

    def once(batch, batch_id):
        sink(batch, batch_id)
        if batch_id in left:
            left.remove(batch_id)
            raise RuntimeError("lost after the write")

    return once


CLAIMS = "session_id string, status string, scored long, claimed_by long"


@pytest.mark.parametrize("kind", ["claim", "append", "reroll"])
def test_a_batch_given_again_changes_nothing(spark, kind):
    results = []
    for fails in (False, True):
        path, second, checkpoint = (io.scratch(spark) for _ in range(3))
        if kind == "claim":
            rows = spark.createDataFrame([(f"s{k % 6}", "scored" if k % 3 else "timed_out", 100 + k) for k in range(18)], "session_id string, status string, scored long").coalesce(1).sortWithinPartitions("scored")
            schema, target = CLAIMS, path
            sink = sinks.claiming(path, CLAIMS, ["session_id"])
        else:
            rows = spark.createDataFrame([(f"s{k % 3}", k % 4, k, 1) for k in range(24)], "session_id string, wave long, offered long, errors long")
            schema, target = "session_id string, wave long, offered long, errors long, batch_id long", path
            sink = sinks.appending(path, schema)
            if kind == "reroll":
                sink, target = sinks.rerolling(path, schema, second, "session_id string, wave long, offered long, errors long", ["session_id", "wave"], ["offered", "errors"]), second
                schema = "session_id string, wave long, offered long, errors long"
        stream = feeds.streamed(rows, 3)
        if fails:
            sink = failing(sink, 1)
            with pytest.raises(Exception, match="lost after the write"):
                sinks.drain(stream, sink, checkpoint)
        sinks.drain(stream, sink, checkpoint)
        found = sinks.table(spark, target, schema).collect()
        columns = [c for c in found[0].asDict() if c not in ("batch_id", "claimed_by", "scored")]
        results.append(sorted(tuple(r[c] for c in columns) for r in found))
    assert results[0] == results[1]
    if kind == "append":
        assert len(results[0]) == 24
    if kind == "reroll":
        assert sum(r[2] for r in results[0]) == sum(range(24))


def test_several_source_rows_of_a_key(spark):
    schema = "session_id string, status string, scored long"
    old = spark.createDataFrame([("a", "timed_out", 0), ("b", "scored", 1)], schema)
    new = spark.createDataFrame([("a", "timed_out", 9), ("a", "scored", 3), ("b", "scored", 8), ("c", "timed_out", 0), ("c", "timed_out", 0)], schema)
    assert sorted(tuple(r) for r in io.claim_upsert(old, new).collect()) == [("a", "scored", 3, True), ("b", "scored", 1, False), ("c", "timed_out", 0, True)]
    assert sorted(tuple(r) for r in io.upsert(old, new, ["session_id"], ["scored"]).collect()) == [("a", "timed_out", 9), ("b", "scored", 8), ("c", "timed_out", 0)]
    assert [r.session_id for r in io.insert_absent(old, new, "session_id").collect()] == ["c"]


def test_the_wave_grid_needs_no_nested_loop(spark):
    for name in ("J17_wave_load", "J18_schedule_check", "A16_peak_climb"):
        plan = catalog.frame(spark, SF, name)._jdf.queryExecution().toString()
        assert "Generate explode(sequence" in plan and "NestedLoop" not in plan, name


def test_scores_name_each_reason(spark):
    found = {r.run_group_id: r for r in catalog.frame(spark, "/root/testdata/sf0.01", "A20_score").collect()}
    assert {g: (r.reason, r.disqualified) for g, r in found.items()} == {"g0": ("correctness_below_threshold", True), "g1": ("session_correctness_below_threshold", True), "g2": (None, False), "g3": ("no ramp session", False), "g4": (None, False)}
    assert found["g2"].incomplete.startswith("s7 covers ") and (found["g2"].first_fail, found["g2"].fail_reason) == (3, "p99_latency")
    climb = {r.session_id: (r.first_fail, r.fail_reason) for r in catalog.frame(spark, "/root/testdata/sf0.01", "A16_peak_climb").collect()}
    assert climb["s11"] == (4, "missing_metrics") and climb["s12"] == (3, "p99_latency")
