"""Reference replay of order books: what each order should have been filled, against what was reported.

A session's orders are inherently sequential and sessions are independent: rows are dealt by session, sorted
by replay order, and one pass over a task's stream keeps only the live book and the orders that still wait in
it. It gives one row per order; reports are plain aggregates over these. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from itertools import takewhile
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrade.plans import catalog

#: The nearness of arrivals of different flows that counts as a tie.
TIE_NS = 100
COUNTS = ("fills", "valid", "overfill", "price_wrong", "queue_jump", "replace_loss", "self_trade", "missed")
OTHER = {"BUY": "SELL", "SELL": "BUY"}


class Order:
    """An order with its reported fills; owed and prices are what the reference filled; turn is its place in the queue once it has rested, kept whether an order that it replaced had it before."""

    __slots__ = ("id", "side", "price", "qty", "kind", "ref", "smp", "eff", "flow", "fills", "owed", "prices", "turn", "kept", "repriced")

    def __init__(self, row: dict):
        self.id, self.side, self.price, self.qty, self.kind = row["order_id"], row["side"], row["price"], row["qty"], row["kind"]
        self.ref, self.smp, self.eff, self.flow, self.fills = row["ref_id"], row["smp_id"], row["eff_t3"], row["flow"], row["fills"] or []
        self.owed, self.prices, self.turn, self.kept, self.repriced = 0, set(), None, False, False


class Resting:
    __slots__ = ("id", "side", "price", "left", "smp", "turn")

    def __init__(self, id, side, price, left, smp, turn):
        self.id, self.side, self.price, self.left, self.smp, self.turn = id, side, price, left, smp, turn


class Steps:
    """The least value of all turns before a turn: only turns whose value is less than that of each earlier one are held."""

    __slots__ = ("turns", "values")

    def __init__(self):
        self.turns, self.values = [], []

    def add(self, turn: int, value: int) -> None:
        i = j = bisect_left(self.turns, turn)
        if i and self.values[i - 1] <= value:
            return
        while j < len(self.turns) and self.values[j] >= value:
            j += 1
        self.turns[i:j], self.values[i:j] = [turn], [value]

    def least(self, turn: int) -> float:
        i = bisect_left(self.turns, turn)
        return self.values[i - 1] if i else inf


class Evidence:
    """All under-reported orders of a side and price that have left the book, held as what an order behind them can ask: the first turn of each
    flow, and the earliest and latest arrival before a turn. As orders come by arrival, one that has a turn of its own never arrived after those
    behind it, so that the latest is sought among kept turns alone, and an earlier arrival on a later turn takes a kept turn too. What is held
    grows with flows and replacements in place, not with the under-reported orders."""

    def __init__(self):
        self.flows, self.early, self.late = {}, Steps(), Steps()

    def add(self, x: Order) -> None:
        self.flows[x.flow] = min(x.turn, self.flows.get(x.flow, x.turn))
        self.early.add(x.turn, x.eff)
        if x.kept:
            self.late.add(x.turn, -x.eff)

    def before(self, o: Order) -> bool:
        """Whether one had its turn before o and is no tie with it."""
        return self.flows.get(o.flow, inf) < o.turn or self.early.least(o.turn) <= o.eff - TIE_NS or self.late.least(o.turn) <= -o.eff - TIE_NS


class Session:
    def __init__(self):
        # price -> resting orders by turn, in the order of the queue, whose head is found at once however many have left it (a plain dict would step over their places)
        self.levels = {"BUY": {}, "SELL": {}}
        self.owners = Counter()  # (side, price, smp) -> how many rest there
        self.heap = {"BUY": [], "SELL": []}
        self.resting, self.waiting, self.turns = {}, OrderedDict(), 0
        self.evidence = {}  # (side, price) -> Evidence

    def rest(self, id, side, price, left, smp):
        self.turns += 1
        r = self.resting[id] = Resting(id, side, price, left, smp, self.turns)
        if price not in self.levels[side]:
            self.levels[side][price] = OrderedDict()
            heapq.heappush(self.heap[side], -price if side == "BUY" else price)
        self.levels[side][price][r.turn] = r
        self.owners[side, price, smp] += 1
        if id in self.waiting:
            self.waiting[id].turn = r.turn

    def leave(self, r):
        del self.levels[r.side][r.price][r.turn], self.resting[r.id]
        self.owners[r.side, r.price, r.smp] -= 1
        if not self.owners[r.side, r.price, r.smp]:
            del self.owners[r.side, r.price, r.smp]

    def match(self, o: Order) -> list[str]:
        """Trades o against the other side, resting what is left of a limit order; the makers that are done."""
        side, left, done, aside = OTHER[o.side], o.qty, [], []
        heap, levels = self.heap[side], self.levels[side]
        while left > 0 and heap:
            price = -heap[0] if side == "BUY" else heap[0]
            if o.kind == "LIMIT" and (price > o.price if o.side == "BUY" else price < o.price):
                break
            key = heapq.heappop(heap)
            gone = []
            for m in levels[price].values():
                if left == 0:
                    break
                if o.smp is not None and m.smp == o.smp:
                    continue  # passed over, keeps its place
                n = min(left, m.left)
                for who in (o, self.waiting.get(m.id)):
                    if who is not None:
                        who.owed += n
                        who.prices.add(price)
                m.left -= n
                left -= n
                if not m.left:
                    gone.append(m)
            for m in gone:
                self.leave(m)
                done.append(m.id)
            if levels[price]:
                aside.append(key)
            else:
                del levels[price]
        for key in aside:
            heapq.heappush(heap, key)
        if left > 0 and o.kind == "LIMIT":
            self.rest(o.id, o.side, o.price, left, o.smp)
        return done

    def replace(self, o: Order) -> list[str]:
        r = self.resting.get(o.ref)
        if r is None:
            return []
        if o.price == r.price and o.qty <= r.left:
            old = self.waiting.get(r.id)
            if old is not None:
                old.turn = None
            del self.resting[r.id]
            r.left, r.id, o.turn, o.kept = o.qty, o.id, r.turn, True
            self.resting[o.id] = r
            return []
        o.repriced = o.price != r.price
        self.leave(r)
        self.rest(o.id, o.side, o.price, o.qty, r.smp)
        return [r.id]

    def apply(self, o: Order) -> Iterator[tuple]:
        self.waiting[o.id] = o
        gone = []
        if o.kind == "CANCEL":
            r = self.resting.get(o.ref)
            if r is not None:
                self.leave(r)
                gone = [r.id]
        else:
            gone = self.replace(o) if o.kind == "REPLACE" else self.match(o)
        for id in gone:
            yield from self.close(id)
        if o.id in self.waiting and o.id not in self.resting:
            yield from self.close(o.id)

    def finish(self) -> Iterator[tuple]:
        for id in list(self.waiting):  # already in replay order
            r = self.resting.get(id)
            if r is not None:  # what is closed is no live evidence: the next one need not step over it
                del self.levels[r.side][r.price][r.turn]
            yield from self.close(id)

    def jumped(self, o: Order, price: int) -> bool:
        """Whether an earlier order of the same side and price was passed over."""
        if o.turn is None:
            return False
        queue = takewhile(lambda r: r.turn < o.turn, self.levels[o.side].get(price, {}).values())
        live = (self.waiting[r.id] for r in queue if r.id in self.waiting)
        if any(x.turn is not None and x.turn < o.turn and x.price == price and (x.flow == o.flow or abs(x.eff - o.eff) >= TIE_NS) for x in live):
            return True
        past = self.evidence.get((o.side, price))
        return past is not None and past.before(o)

    def close(self, id: str) -> Iterator[tuple]:
        o = self.waiting.pop(id, None)
        if o is None:
            return
        n, told = dict.fromkeys(COUNTS, 0), 0
        for f in o.fills:
            told += f["qty"]
            n["fills"] += 1
            if told > o.qty:
                n["overfill"] += 1
            elif f["price"] in o.prices and told <= o.owed:
                n["valid"] += 1
            elif o.smp is not None and (OTHER[o.side], f["price"], o.smp) in self.owners:
                n["self_trade"] += 1
            elif self.jumped(o, f["price"]):
                n["replace_loss" if o.repriced else "queue_jump"] += 1
            else:
                n["price_wrong"] += 1
        if told < o.owed:
            n["missed"] = 1
            if o.turn is not None:
                self.evidence.setdefault((o.side, o.price), Evidence()).add(o)
        yield (o.id, *(n[c] for c in COUNTS))


def grade(orders: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per answered order its counts by class. orders: session_id, order_id, eff_t3, nth, flow, side, price, qty, kind, ref_id, smp_id, fills (array of qty and price, as they arrived)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(graded):
            cols = list(zip(*graded, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["session_id", "order_id", *COUNTS])

        now, book, out = None, Session(), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["session_id"] != now:
                    out += [(now, *x) for x in book.finish()]
                    now, book = row["session_id"], Session()
                out += [(now, *x) for x in book.apply(Order(row))]
            if out:
                yield rows(out)
                out = []
        out = [(now, *x) for x in book.finish()]
        if out:
            yield rows(out)

    dealt = orders.repartition(tasks, "session_id") if tasks else orders.repartition("session_id")
    return dealt.sortWithinPartitions("session_id", "nth").mapInArrow(run, "session_id string, order_id string, " + ", ".join(f"{c} long" for c in COUNTS))


ORDERS = """
select r.session_id, r.order_id, r.eff_t3, r.nth, r.src_ip * 65536 + r.src_port as flow, s.side, s.price * 1000000000 as price, s.qty,
       case when s.payload_type in ('CANCEL', 'REPLACE') then s.payload_type else s.ord_type end as kind, nullif(s.orig_order_id, '') as ref_id, s.smp_id, f.fills
from replayed r join orders_sent s on s.session_id = r.session_id and s.order_id = r.order_id
left join (select session_id, order_id, transform(sort_array(collect_list(struct(t7, exec_type, fill_qty as qty, fill_price as price))), x -> struct(x.qty, x.price)) as fills
  from (select distinct session_id, order_id, t7, exec_type, fill_qty, fill_price from orders_acked where fill_qty > 0 and exec_type in ('1', '2', 'F')) d group by session_id, order_id) f
on f.session_id = r.session_id and f.order_id = r.order_id"""


def R_replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: its counts by class, answered orders, dirty ones, and the order-level score; lost orders count and are dirty."""
    graded = grade(catalog.run(spark, sf_dir, ORDERS))
    bad = F.col("fills") > F.col("valid")
    sums = graded.groupBy("session_id").agg(*(F.sum(c).alias(c) for c in COUNTS), F.count("*").alias("graded"), F.count_if(bad | (F.col("missed") > 0)).alias("dirty"))
    lost = catalog.run(spark, sf_dir, "select session_id, count(*) as lost from outcomes where outcome = 'lost' group by session_id")
    both = sums.join(lost, "session_id", "full_outer").na.fill(0)
    scored = F.col("graded") + F.col("lost")
    return both.withColumn("score", F.when(scored == 0, 1.0).otherwise((scored - F.col("dirty") - F.col("lost")) / scored))


def queries() -> dict:
    return {"R_replay_report": R_replay_report}
