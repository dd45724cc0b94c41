"""Joins in time: an answer counts for its order only inside a window after it. The batch form; wavegrade/streaming/live.py has the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_NS = 500_000_000
ANSWER = ["session_id", "order_id", "exec_type", "t3", "t7", "fill_qty", "fill_price"]


def in_window(window_ns: int, skew_ns: int) -> Column:
    """An answer's t3 lies at most window_ns after its order (and skew_ns before it, for clocks that differ)."""
    return (F.col("t3") >= F.col("t0") - skew_ns) & (F.col("t3") <= F.col("t0") + window_ns)


def sides(sent: DataFrame, acked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both inputs with names that do not clash, answers without redeliveries."""
    return sent.select(F.col("session_id").alias("s_session"), F.col("order_id").alias("s_order"), "t0", "timed_out"), acked.select(*ANSWER)


def outcomes(sent: DataFrame, acked: DataFrame, window_ns: int = WINDOW_NS, skew_ns: int = 0) -> DataFrame:
    """A row for each order: matched, lost (the client gave up) or gap (the capture missed it); and one for each id with answers
    outside any order's window: phantom if one of them is a fill, else unsent."""
    s, a = sides(sent, acked)
    return classified(s.join(a.distinct(), (F.col("s_session") == F.col("session_id")) & (F.col("s_order") == F.col("order_id")) & in_window(window_ns, skew_ns), "full_outer"))


def classified(pairs: DataFrame) -> DataFrame:
    """Outcomes of the rows that a full outer join of orders and answers gives, of a batch or of a stream that has ended."""
    return counted(told(pairs))


def told(pairs: DataFrame) -> DataFrame:
    """What an outcome needs of each of these rows, and no more."""
    fill = (F.col("fill_qty") > 0) & F.col("exec_type").isin("1", "2", "F")
    return pairs.select(F.coalesce("s_session", "session_id").alias("session_id"), F.coalesce("s_order", "order_id").alias("order_id"), F.col("s_order").isNotNull().alias("sent"), F.col("t3").isNotNull().alias("answered"), "fill_qty", "timed_out", fill.alias("fill"))


def counted(rows: DataFrame) -> DataFrame:
    """Outcomes of the rows of told."""
    seen = rows.groupBy("session_id", "order_id", "sent")
    sums = seen.agg(F.count_if("answered").alias("n_acks"), F.coalesce(F.sum("fill_qty"), F.lit(0)).cast("long").alias("filled"), F.max("timed_out").alias("timed_out"), F.max("fill").alias("fills"))
    outcome = F.when(F.col("sent") & (F.col("n_acks") > 0), "matched").when(F.col("sent") & F.col("timed_out"), "lost").when(F.col("sent"), "gap").when(F.col("fills"), "phantom").otherwise("unsent")
    return sums.select("session_id", "order_id", outcome.alias("outcome"), "n_acks", "filled")
