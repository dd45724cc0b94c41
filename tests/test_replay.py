"""Replay grading on small books whose right fills are plain to see."""

from wavegrade.operators import replay

SF = "/root/testdata/sf0.001"
SCHEMA = "session_id string, order_id string, eff_t3 long, nth long, flow long, side string, price long, qty long, kind string, ref_id string, smp_id long, fills array<struct<qty:long,price:long>>"


def graded(spark, *orders):
    rows = [("s", id, 1000 * i, i, i, side, price, qty, kind, ref, smp, fills) for i, (id, side, price, qty, kind, ref, smp, fills) in enumerate(orders)]
    return {r["order_id"]: {c: r[c] for c in replay.COUNTS if r[c]} for r in replay.grade(spark.createDataFrame(rows, SCHEMA), 2).collect()}


def test_right_fills_are_valid(spark):
    got = graded(spark, ("a", "SELL", 10, 5, "LIMIT", None, None, [(5, 10)]), ("b", "SELL", 10, 5, "LIMIT", None, None, [(2, 10)]), ("c", "BUY", 11, 7, "LIMIT", None, None, [(5, 10), (2, 10)]))
    assert got == {"a": {"fills": 1, "valid": 1}, "b": {"fills": 1, "valid": 1}, "c": {"fills": 2, "valid": 2}}


def test_silence_is_missed_and_jump_is_seen(spark):
    got = graded(spark, ("a", "SELL", 10, 5, "LIMIT", None, None, []), ("b", "SELL", 10, 5, "LIMIT", None, None, [(5, 10)]), ("c", "BUY", 10, 5, "MARKET", None, None, [(5, 10)]))
    assert got == {"a": {"missed": 1}, "b": {"fills": 1, "queue_jump": 1}, "c": {"fills": 1, "valid": 1}}


def test_same_owner_is_passed_over(spark):
    got = graded(spark, ("a", "SELL", 10, 5, "LIMIT", None, 0, []), ("b", "SELL", 11, 5, "LIMIT", None, 1, [(5, 11)]), ("c", "BUY", 11, 5, "LIMIT", None, 0, [(5, 11)]), ("d", "BUY", 9, 5, "LIMIT", None, 0, [(5, 10)]))
    assert got == {"a": {}, "b": {"fills": 1, "valid": 1}, "c": {"fills": 1, "valid": 1}, "d": {"fills": 1, "self_trade": 1}}


def test_cancel_replace_overfill(spark):
    got = graded(spark, ("a", "SELL", 10, 5, "LIMIT", None, None, []), ("b", "SELL", 12, 5, "REPLACE", "a", None, [(9, 12)]), ("c", "BUY", 11, 5, "LIMIT", None, None, []), ("d", "BUY", 9, 1, "CANCEL", "c", None, []), ("e", "SELL", 9, 5, "LIMIT", None, None, [(5, 9)]))
    assert got == {"a": {}, "b": {"fills": 1, "overfill": 1}, "c": {}, "d": {}, "e": {"fills": 1, "price_wrong": 1}}


def test_empty_and_whole_tables(spark):
    assert replay.grade(spark.createDataFrame([], SCHEMA)).count() == 0
    report = replay.R_replay_report(spark, SF).collect()
    assert len(report) == 20 and all(0 <= r["score"] <= 1 and r["fills"] == sum(r[c] for c in replay.COUNTS[1:7]) for r in report)
