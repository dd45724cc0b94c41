"""Cases of the findings of round 4."""

import os
import random

from wavegrade.operators import feeds, intime, replay
from wavegrade.plans import catalog
from wavegrade.sources import io
from wavegrade.streaming import live

SF = "/root/testdata/sf0.001"


def test_streams_in_step_write_little_and_keep_some_versions(spark, monkeypatch, tmp_path):
    """No copy beside the sorted files, no columns that no outcome needs, the latest versions of the state and not all, the session's settings as before, the rows of the batch."""
    made = []

    def folder(spark):
        made.append(f"{tmp_path}/f{len(made)}")
        return made[-1]

    monkeypatch.setattr(feeds, "folder", folder)
    monkeypatch.setattr(io, "scratch", folder)
    monkeypatch.setattr(feeds, "BATCH_ROWS", 500)
    monkeypatch.setattr(feeds, "BATCH_FILES", 2)
    want = {tuple(r) for r in catalog.queries()["J01_in_time"](spark, SF).collect()}
    names = (*io.FREED, *live.LATEST, "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in names]
    assert {tuple(r) for r in catalog.queries()["T09_outcomes_in_time"](spark, SF).collect()} == want
    assert [spark.conf.get(k) for k in names] == before and len(made) == 3
    (out,) = (f for f in os.listdir(made[2]) if not f.endswith("-state"))
    assert set(spark.read.parquet(f"{made[2]}/{out}").columns) == {"session_id", "order_id", "sent", "answered", "fill_qty", "timed_out", "fill"}
    batches = sorted(int(f) for f in os.listdir(f"{made[2]}/{out}-state/commits") if f.isdigit())
    assert batches[-1] >= 10 and len(batches) <= 5


def test_end_marks_of_empty_streams(spark):
    """sides without rows, one or both."""
    sent = spark.createDataFrame([], "session_id string, order_id string, t0 long, timed_out boolean")
    acked = spark.createDataFrame([], "session_id string, order_id string, exec_type string, t3 long, t7 long, fill_qty long, fill_price long")
    one = spark.createDataFrame([("s", "a", 10**18, True)], sent.schema)
    for s, want in ((sent, []), (one, [("s", "a", "lost", 0, 0)])):
        sides = feeds.in_step((s, "t0"), (acked, "t3"), mark=True)
        told = intime.told(live.outcomes_in_time(*sides)).where("session_id <> ''")
        assert [tuple(r) for r in intime.counted(live.run(told, feeds.folder(spark), most_parts=4)).collect()] == want


def order(id, side, price, qty, eff, fills=(), kind="LIMIT", ref=None, flow=1, smp=None):
    return replay.Order({"order_id": str(id), "side": side, "price": price, "qty": qty, "kind": kind, "ref_id": ref, "smp_id": smp, "eff_t3": eff, "flow": flow, "fills": [{"qty": q, "price": p} for q, p in fills]})


def test_an_old_victim_stays_evidence():
    """F2, R: a queue jump is told however many orders were under-reported after its victim, and their number is not what is held."""
    book, n, rows = replay.Session(), 70_000, []
    orders = [order("first", "SELL", 10, 5, 0), order("jumper", "SELL", 10, 5, 1000, [(5, 10)]), order("taker", "BUY", 10, 5, 2000, [(5, 10)])]
    for i in range(n):
        orders += [order(f"m{i}", "BUY", 5, 1, 3000 + 2000 * i, flow=i % 3), order(f"t{i}", "SELL", 5, 1, 4000 + 2000 * i, [(1, 5)])]
    for o in orders:
        rows += book.apply(o)
    rows += book.finish()
    got = {r[0]: {c: v for c, v in zip(replay.COUNTS, r[1:], strict=True) if v} for r in rows}
    assert got["first"] == {"missed": 1} and got["jumper"] == {"fills": 1, "queue_jump": 1} and got["taker"] == {"fills": 1, "valid": 1}
    assert len(got) == 2 * n + 3 and sum("missed" in g for g in got.values()) == n + 1
    held = book.evidence["BUY", 5]
    assert len(held.flows) == 3 and len(held.early.turns) == 1 and not held.late.turns


def test_evidence_answers_as_all_orders_would(monkeypatch):
    """F2, R: against a scan of all under-reported orders, on random books with ties, many flows and replacements in place."""
    asked = {True: 0, False: 0, "late": 0}

    class Scanned(replay.Evidence):
        def __init__(self):
            super().__init__()
            self.all = []

        def add(self, x):
            self.all.append((x.turn, x.eff, x.flow))
            super().add(x)

        def before(self, o):
            want = any(turn < o.turn and (flow == o.flow or abs(eff - o.eff) >= replay.TIE_NS) for turn, eff, flow in self.all)
            assert super().before(o) == want
            asked[want] += 1
            asked["late"] += want and not any(turn < o.turn and (flow == o.flow or eff <= o.eff - replay.TIE_NS) for turn, eff, flow in self.all)
            return want

    monkeypatch.setattr(replay, "Evidence", Scanned)
    rng = random.Random(4)
    for _ in range(500):
        book, eff, apart = replay.Session(), 0, rng.choice([5, 40, 90])
        resting = book.resting
        for i in range(150):
            eff += rng.randrange(apart)
            side, price, qty, kind, ref = rng.choice(["BUY", "SELL"]), rng.randrange(9, 12), rng.randrange(1, 6), rng.choice(["LIMIT"] * 5 + ["MARKET", "CANCEL", "REPLACE", "REPLACE"]), None
            if kind in ("CANCEL", "REPLACE") and resting:
                r = resting[rng.choice(sorted(resting))]
                side, price, qty, ref = (r.side, r.price, rng.randrange(1, r.left + 1), r.id) if rng.random() < 0.8 else (r.side, price, qty, r.id)
            fills = [(rng.randrange(1, 4), rng.randrange(9, 12))] if rng.random() < 0.6 else []
            list(book.apply(order(i, side, price, qty, eff, fills, kind, ref, rng.randrange(6))))
        list(book.finish())
    assert asked[True] > 500 and asked[False] > 500 and asked["late"] > 0, asked
