"""Violations that need no order book, a row for each, and what is counted from them.

Classes: overfill (a fill that takes its order's fills above its quantity), time (an answer out of sequence inside its flow, or after a
later order of another flow by more than is allowed; an order can be both), lost_order and lost_cancel (no usable answer). Phantoms,
fills of orders that nobody sent, are a figure beside them and no class. Redelivered answers count once; answers of unsent orders are
not graded. Price, self_trade, missed_fill and cancel_replace_loss need a book and are not found here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrade.operators import ordering
from wavegrade.sources import io

KEY = ["session_id", "order_id"]
CLASSES = ("overfill", "time", "lost_order", "lost_cancel")
IS_FILL = "fill_qty > 0 and exec_type in ('1', '2', 'F')"


def violations(sent: DataFrame, acked: DataFrame, allowed_ns: int = 500_000, anomaly_cap_ns: int | None = None, parts: int | None = None) -> DataFrame:
    """A row for each violation: session_id, order_id, class, detail. An answer is usable if t7 lies not before t3, and not more than
    anomaly_cap_ns after it; an order without usable answers is lost if its client gave up or it has unusable ones, else a gap."""
    usable = F.col("t7") >= F.col("t3")
    if anomaly_cap_ns is not None:
        usable &= F.col("t7") - F.col("t3") <= anomaly_cap_ns
    first = lambda t: F.min(F.when(usable, F.col(t)))
    # One row for each order (and place in a flow) before anything is shuffled or joined: a redelivered answer changes none of these, but the sum, which may only be too great.
    place = [*KEY, "src_ip", "src_port", "tcp_seq"]
    orders = acked.groupBy(*place).agg(first("t3").alias("t3"), first("t7").alias("min_t7"), F.coalesce(F.max(usable), F.lit(False)).alias("usable"), F.sum(F.when(F.expr(IS_FILL), F.col("fill_qty"))).alias("most"))
    orders = io.stored(orders.join(sent.groupBy(*KEY).agg(F.min("qty").alias("qty"), F.count("*").alias("times")).hint("shuffle_hash"), KEY))
    told = orders.groupBy(*KEY).agg(F.max("usable").alias("_usable"), (F.sum("most") * F.max("times") > F.min("qty")).alias("_over"))
    # Only orders that can be overfilled have their fills told apart and summed in order.
    fills = acked.where(IS_FILL).select(*place, "t3", "t7", "exec_type", "fill_qty", "fill_price").join(told.where("_over").select(*KEY).hint("shuffle_hash"), KEY, "left_semi")
    so_far = F.sum("fill_qty").over(Window.partitionBy(*KEY).orderBy("t7", "exec_type", "fill_qty", "fill_price").rowsBetween(Window.unboundedPreceding, 0))
    over = fills.distinct().join(sent.select(*KEY, "qty").distinct(), KEY).withColumn("_cum", so_far).where("_cum > qty").select(*KEY, F.lit("overfill").alias("class"), F.col("fill_qty").cast("string").alias("detail"))
    graded = io.stored(ordering.with_breach(ordering.carried(orders.where("usable").select(*place, "t3", "min_t7"))))
    fifo = graded.where("breach").select(*KEY, F.lit("time").alias("class"), F.lit("flow").alias("detail"))
    cross = ordering.judged(ordering.cross(graded, parts), allowed_ns).where("violation").select(*KEY, F.lit("time").alias("class"), F.lit("cross").alias("detail"))
    lost = sent.select(*KEY, "payload_type", "timed_out").distinct().join(told, KEY, "left").where("not coalesce(_usable, false) and (timed_out or _usable is not null)")
    lost = lost.select(*KEY, F.when(F.col("payload_type") == "CANCEL", "lost_cancel").otherwise("lost_order").alias("class"), F.lit("").alias("detail"))
    return over.unionByName(fifo).unionByName(cross).unionByName(lost)


def phantoms(sent: DataFrame, acked: DataFrame) -> DataFrame:
    """Of each session the fills of orders that nobody sent."""
    fills = acked.where(IS_FILL).select(*KEY, "exec_type", "t3", "t7", "fill_qty", "fill_price")
    return fills.join(sent.select(*KEY).hint("shuffle_hash"), KEY, "left_anti").distinct().groupBy("session_id").agg(F.count("*").alias("phantoms"))


def counters(found: DataFrame, by: list[str]) -> DataFrame:
    """A column for each class; only keys with a violation have a row."""
    return found.groupBy(*by).agg(*(F.count_if(F.col("class") == c).alias(c) for c in CLASSES), F.count("*").alias("violations"))


def examples(found: DataFrame, most: int = 100) -> DataFrame:
    """Of each session and class at most so many violations, the first by order id as text, then detail; counts are not touched by it."""
    nth = F.row_number().over(Window.partitionBy("session_id", "class").orderBy("order_id", "detail"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most)


def class_counts(found: DataFrame) -> DataFrame:
    """Session, class and how many, where there are any."""
    return found.groupBy("session_id", "class").agg(F.count("*").alias("n"))


def summary(found: DataFrame) -> DataFrame:
    """Each class with its number and share of all, the most frequent first."""
    n = found.groupBy("class").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("class", "n", "total", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "class")
