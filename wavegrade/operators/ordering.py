"""Replay order, order breaches and cross-flow jitter, as functions on answers.

An order across a session is never made in one task: rows are dealt by ranges of the order's keys, each range gives a
summary, and the summaries of earlier ranges go into each range's own windows. A session of any size is so many ranges.
Answers: session_id, order_id, src_ip, src_port, tcp_seq, t3, t7. Ties fall by the number that the order id holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrade.sources import io

SESSION, FLOW = ["session_id"], ["session_id", "src_ip", "src_port"]
#: Arrival, and the order in which the session's engine answered.
ARRIVAL = ["eff_t3", "src_ip", "src_port", "tcp_seq", "order_no"]
ANSWERED = ["min_t7", *ARRIVAL]


def effective(acked: DataFrame) -> DataFrame:
    """A row for each answered order; eff_t3 is the greatest t3 of its flow up to it in sequence order."""
    return carried(acked.groupBy("session_id", "order_id", "src_ip", "src_port", "tcp_seq").agg(F.min("t3").alias("t3"), F.min("t7").alias("min_t7")))


def carried(one: DataFrame) -> DataFrame:
    """W04 from a row for each answered order, with its least t3 and t7."""
    return one.withColumn("order_no", F.col("order_id").cast("long")).withColumn("eff_t3", F.max("t3").over(Window.partitionBy(*FLOW).orderBy("tcp_seq", "order_no").rowsBetween(Window.unboundedPreceding, 0)))


def ranged(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The rows with the range of (session, keys) that they lie in, as a written table, so that a range stays what it is."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return io.stored(rows.repartitionByRange(n, *SESSION, *keys).withColumn("part", F.spark_partition_id()))


def replay_order(acked: DataFrame, parts: int | None = None) -> DataFrame:
    """The place of each answered order in its session: by effective arrival, flow and sequence."""
    rows = ranged(effective(acked), ARRIVAL, parts)
    sizes = rows.groupBy(*SESSION, "part").agg(F.count("*").alias("n"))
    ahead = sizes.select(*SESSION, "part", (F.sum("n").over(Window.partitionBy(*SESSION).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(*SESSION, "part").orderBy(*ARRIVAL))
    return rows.withColumn("inside", inside).join(ahead, [*SESSION, "part"]).withColumn("nth", F.col("ahead") + F.col("inside")).drop("part", "inside", "ahead")


def wrapped(a: str, b: str):
    """A minus b of sequence numbers that wrap at 2^32."""
    return F.pmod(F.col(a) - F.col(b) + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)


def flow_breaches(acked: DataFrame) -> DataFrame:
    """Orders answered before one of their flow that came earlier: the sequence number isn't above that of the flow's last answer."""
    return with_breach(effective(acked)).where("breach").select("session_id", "order_id")


def with_breach(rows: DataFrame) -> DataFrame:
    """Rows of carried, and whether each is a breach of its flow."""
    before = F.lag("tcp_seq").over(Window.partitionBy(*FLOW).orderBy(*ANSWERED))
    return rows.withColumn("before", before).withColumn("breach", F.coalesce(wrapped("tcp_seq", "before") <= 0, F.lit(False))).drop("before")


def cross_flow(acked: DataFrame, parts: int | None = None) -> DataFrame:
    """For each order the greatest t3 of orders of other flows that were answered before it (null if none).

    A range's summary is its two greatest t3 of different flows; summaries combine in any order, so those of all earlier
    ranges stand as two rows in front of a range. Inside a range the greatest t3 so far has a holder; rows of other flows
    take it, rows of the holder's flow take the best of others: that before the holder took over, or since.
    """
    return cross(effective(acked), parts)


def cross(carried_rows: DataFrame, parts: int | None = None) -> DataFrame:
    """W07 from rows of carried."""
    flow = (F.col("src_ip") * 65536 + F.col("src_port")).alias("flow")
    rows = ranged(carried_rows.select("session_id", "order_id", flow, "t3", *ANSWERED), ANSWERED, parts)
    tops = rows.groupBy(*SESSION, "part", "flow").agg(F.max("t3").alias("t3"))
    nth = F.row_number().over(Window.partitionBy(*SESSION, "part").orderBy(F.desc("t3"), "flow"))
    two = tops.withColumn("nth", nth).where("nth <= 2").groupBy(*SESSION, "part").agg(F.collect_list(F.struct("t3", "flow")).alias("two"))
    earlier = F.flatten(F.collect_list("two").over(Window.partitionBy(*SESSION).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    best = two.select(*SESSION, "part", earlier.alias("e")).where("size(e) > 0").select(*SESSION, "part", F.array_max("e").alias("best"), "e")
    seeds = best.select(*SESSION, "part", F.explode(F.array_compact(F.array("best", F.array_max(F.filter("e", lambda x: x["flow"] != F.col("best.flow")))))).alias("s")).select(*SESSION, "part", F.col("s.t3").alias("t3"), F.col("s.flow").alias("flow"))
    all_rows = rows.withColumn("seed", F.lit(0)).unionByName(seeds.withColumn("seed", F.lit(1)), allowMissingColumns=True)
    group, order = Window.partitionBy(*SESSION, "part"), [F.desc("seed"), *ANSWERED, "t3"]
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = all_rows.withColumn("top_t3", F.max("t3").over(before)).withColumn("top_flow", F.max_by("flow", "t3").over(before))
    held = held.withColumn("old_flow", F.lag("top_flow").over(group.orderBy(*order))).withColumn("old_t3", F.lag("top_t3").over(group.orderBy(*order)))
    held = held.withColumn("turn", F.sum(F.when(F.col("old_flow").isNull() | (F.col("old_flow") != F.col("top_flow")), 1).otherwise(0)).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    turn = Window.partitionBy(*SESSION, "part", "turn")
    ordered = turn.orderBy(*order)
    held = held.withColumn("before_t3", F.first("old_t3").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("inside_t3", F.max(F.when(F.col("flow") != F.col("top_flow"), F.col("t3"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    other = F.when(F.col("top_flow") != F.col("flow"), F.col("top_t3")).otherwise(F.greatest("before_t3", "inside_t3"))
    return held.where("seed = 0").select("session_id", "order_id", "t3", other.alias("other_t3"))


def jitter(acked: DataFrame, allowed_ns: int = 500_000, parts: int | None = None) -> DataFrame:
    """Whether an order was answered after a later one of another flow, by how much, and whether by more than is allowed."""
    return judged(cross_flow(acked, parts), allowed_ns)


def judged(crossed: DataFrame, allowed_ns: int = 500_000) -> DataFrame:
    """P21 from rows of cross."""
    late = F.col("other_t3") > F.col("t3")
    gap = F.col("other_t3") - F.col("t3")
    return crossed.select("session_id", "order_id", F.coalesce(late, F.lit(False)).alias("inversion"), F.when(late, gap).otherwise(0).alias("jitter_ns"), F.coalesce(gap > allowed_ns, F.lit(False)).alias("violation"))


def jitter_stats(acked: DataFrame, parts: int | None = None) -> DataFrame:
    """Of each session with inversions their number and share of its orders, the greatest gap, and percentiles of the gaps as the lower bound of the power of two at rank trunc(p (n - 1))."""
    j = jitter(acked, parts=parts)
    whole = j.groupBy("session_id").agg(F.count_if("inversion").alias("n"), F.count("*").alias("orders"), F.max("jitter_ns").alias("top_ns")).where("n > 0")
    steps = j.where("inversion").groupBy("session_id", F.length(F.bin("jitter_ns")).alias("bits")).agg(F.count("*").alias("c"))
    cum = steps.withColumn("cum", F.sum("c").over(Window.partitionBy("session_id").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda q: F.min(F.when(F.col("cum") > F.floor(F.lit(q) * (F.col("n") - 1)), F.expr("shiftleft(1L, bits - 1)")))
    return cum.join(whole, "session_id").groupBy("session_id", "n", "top_ns", (F.col("n") / F.col("orders")).alias("rate")).agg(at(0.5).alias("p50"), at(0.99).alias("p99"), at(0.999).alias("p999"))


def worst_jitter(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each run group the greatest of each figure over its sessions."""
    return stats.join(runs.select("session_id", "run_group_id"), "session_id").groupBy("run_group_id").agg(*(F.max(c).alias(c) for c in ("p50", "p99", "p999", "top_ns", "rate")))
