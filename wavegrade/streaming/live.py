"""Streaming operators. Each takes streaming (or batch) DataFrames of events and returns one; run drains a query.

Event times are nanoseconds; at gives the timestamp that watermarks need. State is bounded by watermarks, never
by counts. A stream's result equals the batch form once all input is in and the watermark has passed; what the
watermark still holds back is stated with each function.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wavegrade.operators import intime
from wavegrade.sources import io

WAVE_NS, SECOND_NS = 20_000_000_000, 1_000_000_000


#: What a stream keeps of its state's earlier versions: on disk what a run that failed goes on from, the last batch but one, in memory the last alone. A
#: version holds all that came and went in its batch, so that a hundred of them, as is Spark's own number, are the whole input some times over.
LATEST = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2", "spark.sql.streaming.stateStore.maintenanceInterval": "15s", "spark.sql.streaming.maxBatchesToRetainInMemory": "1"}


def at(ns: str) -> Column:
    """A timestamp (microseconds) of a nanosecond column."""
    return F.timestamp_micros(F.expr(f"{ns} div 1000"))


def wave(time_col: str, origin_col: str, wave_ns: int = WAVE_NS) -> Column:
    """The wave of an event, counted from the session's origin."""
    return F.expr(f"greatest({time_col} - {origin_col}, 0) div {wave_ns}")


def run(stream: DataFrame, path: str, mode: str = "append", most_parts: int | None = None) -> DataFrame:
    """Drain a streaming DataFrame (all input there is) and return what it gave, as Parquet under path: all rows in append mode; in complete
    mode the last batch's, each batch in a folder of its own number, so that one that comes again takes its own place. Nothing passes the driver.
    most_parts: for streams of bounded batches in the order of event time, whose state is the rows of some batches. It is held in so many
    partitions at most, in maps of the executors' memory, where a row takes a fraction of the time that RocksDB needs; on disk, too, the
    versions of some batches are kept and not of a hundred (LATEST)."""
    spark, name, shuffles = stream.sparkSession, f"live_{uuid.uuid4().hex}", "spark.sql.shuffle.partitions"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", f"org.apache.spark.sql.execution.streaming.state.{'HDFSBacked' if most_parts else 'RocksDB'}StateStoreProvider")
    now = int(spark.conf.get(shuffles))
    with io.settings(spark, {shuffles: str(min(now, most_parts or now))} | (LATEST | io.FREED if most_parts else {})):
        return drained(stream, f"{path}/{name}", mode)


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    if mode != "complete":
        raise ValueError(f"{mode}: rows of update mode need a sink that merges them (sinks.upserting)")
    last = []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        last[:] = [batch_id]

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def wave_counts(sent: DataFrame) -> DataFrame:
    """Orders and timeouts of each tumbling wave, anchored at the session's barrier; run in complete or update mode."""
    return sent.groupBy("session_id", wave("t0", "barrier_epoch_ns").alias("wave")).agg(F.count("*").alias("offered"), F.count_if("timed_out").alias("timed_out"))


def interval_counts(sent: DataFrame) -> DataFrame:
    """Counters of each second of each wave, in place of counters that are reset at each emission."""
    second = F.expr(f"t0 - t0 % {SECOND_NS}")
    return sent.groupBy("session_id", wave("t0", "barrier_epoch_ns").alias("wave"), second.alias("second_ns")).agg(F.count("*").alias("offered"), F.count_if("timed_out").alias("errors"))


def closed_windows(sent: DataFrame, idle: str = "30 seconds", width: str = "20 seconds") -> DataFrame:
    """Waves on the clock that have been idle for so long; their state, the session's data with it, is dropped as they are given out. Later windows are held back."""
    timed = sent.withColumn("at", at("t0")).withWatermark("at", idle)
    return timed.groupBy("session_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.max("contestant_id").alias("contestant_id")).select("session_id", F.unix_seconds("w.start").alias("start_s"), "n", "contestant_id")


def first_responses(acked: DataFrame, idle: str = "5 seconds") -> DataFrame:
    """The first answer to arrive of each order; remembered for idle."""
    return acked.withColumn("at", at("t3")).withWatermark("at", idle).dropDuplicatesWithinWatermark(["session_id", "order_id"]).drop("at")


def answers_in_time(sent: DataFrame, acked: DataFrame, memory: str = "15 seconds") -> DataFrame:
    """Answers with whether the client had timed the order out; orders and answers are remembered for memory."""
    s = sent.select(F.col("session_id").alias("s_session"), F.col("order_id").alias("s_order"), "timed_out", at("t0").alias("sent_at")).withWatermark("sent_at", memory)
    a = acked.withColumn("at", at("t3")).withWatermark("at", memory)
    return a.join(s, F.expr(f"session_id = s_session and order_id = s_order and at between sent_at - interval 1 second and sent_at + interval {memory}")).select("session_id", "order_id", "t3", "t7", "exec_type", "timed_out")


def sealed_seconds(rows: DataFrame, seal: str = "3 seconds") -> DataFrame:
    """Sums of each second that is older than the newest by the seal; younger ones wait. The checkpoint advances only after a write."""
    timed = rows.withColumn("at", at("second_ns")).withWatermark("at", seal)
    return timed.groupBy("session_id", F.window("at", "1 second").alias("w")).agg(F.sum("offered").alias("offered"), F.sum("errors").alias("errors")).select("session_id", F.unix_seconds("w.start").alias("second_s"), "offered", "errors")


def reroll(metrics: DataFrame, history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Metrics with the waves that fresh rows touch computed anew from history and fresh; all others stay. For foreachBatch."""
    keys = ["session_id", "wave"]
    touched = fresh.select(*keys).distinct()
    again = history.unionByName(fresh).join(touched, keys, "left_semi").groupBy(*keys).agg(F.sum("offered").alias("offered"), F.sum("errors").alias("errors"))
    return io.upsert(metrics, again, keys)


def matched_in_window(sent: DataFrame, acked: DataFrame, window: str = "500 milliseconds") -> DataFrame:
    """(order, answer) pairs whose answer came within the window after the order; orders without one are graded when the session is whole."""
    s = sent.select(F.col("session_id").alias("s_session"), F.col("order_id").alias("s_order"), at("t0").alias("sent_at")).withWatermark("sent_at", "1 second")
    a = acked.withColumn("at", at("t3")).withWatermark("at", "1 second")
    return a.join(s, F.expr(f"session_id = s_session and order_id = s_order and at between sent_at and sent_at + interval {window}")).select("session_id", "order_id", "t3", "t7", "exec_type", "fill_qty")


def outcomes_in_time(sent: DataFrame, acked: DataFrame, window_ns: int = intime.WINDOW_NS, skew_ns: int = 0, late: str = "2 seconds") -> DataFrame:
    """T09, J01 as a stream: a full outer join inside the window. Pairs come at once; orders and answers that found none come once the watermark has
    passed their window. An answer's event time is its t3, so that late fills of an old order are not late. The times of the join are microseconds
    and hold one more on each side than the window; the nanoseconds decide. Redelivered answers are dropped while the watermark remembers them."""
    s, a = intime.sides(sent, acked)
    s = s.withColumn("sent_at", at("t0")).withWatermark("sent_at", late)
    a = a.withColumn("at", at("t3")).withWatermark("at", late).dropDuplicatesWithinWatermark(intime.ANSWER)
    around = F.expr(f"at >= sent_at - interval {skew_ns // 1000 + 1} microseconds and at <= sent_at + interval {window_ns // 1000 + 1} microseconds")
    keys = (F.col("s_session") == F.col("session_id")) & (F.col("s_order") == F.col("order_id"))
    return s.join(a, keys & around & intime.in_window(window_ns, skew_ns), "full_outer").drop("sent_at", "at")


def answered_or_evicted(requests: DataFrame, responses: DataFrame, idle: str = "5 seconds") -> DataFrame:
    """T12, J05 as a stream: each answer with the earliest request of its id, if it came within idle; requests without one are given out with a null t7
    when the watermark has passed that time, and leave the state. There is no capacity: state goes to the state store. Requests: session_id,
    order_id, t3; responses: session_id, order_id, t7."""
    r = requests.select(F.col("session_id").alias("r_session"), F.col("order_id").alias("r_order"), "t3", at("t3").alias("asked_at")).withWatermark("asked_at", idle).dropDuplicatesWithinWatermark(["r_session", "r_order"])
    a = responses.select("session_id", "order_id", "t7", at("t7").alias("answered_at")).withWatermark("answered_at", idle)
    near = F.expr(f"r_session = session_id and r_order = order_id and answered_at >= asked_at and answered_at <= asked_at + interval {idle}")
    return r.join(a, near, "left_outer").select(F.col("r_session").alias("session_id"), F.col("r_order").alias("order_id"), "t3", "t7")


class FlowBuffer(StatefulProcessor):
    """Of one flow: the records that the watermark has not passed, and the greatest t3 released."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("order_id", StringType()), StructField("tcp_seq", LongType()), StructField("t3", LongType())]))
        self.reached = handle.getValueState("reached", StructType([StructField("t3", LongType())]))

    def _set_timer(self, rows: list[tuple], known: bool = False) -> None:
        """At the first of rows, and of those that are waiting already (known: their timer tells it, so that they are not read)."""
        olds = list(self.handle.listTimers())
        due = min([r[2] // 1_000_000 + 1 for r in rows] + (olds if known else []), default=None)
        for old in olds:
            if old != due:
                self.handle.deleteTimer(old)
        if due is not None and due not in olds:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        new = [(o, int(s), int(t)) for part in rows for o, s, t in part[["order_id", "tcp_seq", "t3"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self._set_timer(new, known=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1_000_000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], int(r[0] or 0)))
        n = next((i for i, r in enumerate(rows) if r[2] >= passed), len(rows))  # the flow's order holds back what comes after a younger record
        top = self.reached.get()[0] if self.reached.exists() else None
        out = []
        for order_id, _, t3 in rows[:n]:
            top = t3 if top is None else max(top, t3)
            out.append((*key, order_id, top))
        if rows[n:]:
            self.waiting.put(rows[n:])
        else:
            self.waiting.clear()
        if top is not None:
            self.reached.update((top,))
        waiting = [r for r in rows[n:] if r[2] >= passed]
        self._set_timer(waiting)
        yield pd.DataFrame(out, columns=["session_id", "src_ip", "src_port", "order_id", "eff_t3"])

    def close(self) -> None:
        pass


def in_arrival_order(acked: DataFrame, late: str = "2 seconds") -> DataFrame:
    """T10, W04 as a stream: records of a flow in sequence order, each with the greatest t3 up to it, given out when the watermark has passed
    them and all before them. A flow keeps what the watermark holds back and one number. Needs the RocksDB state store."""
    timed = acked.select("session_id", "src_ip", "src_port", "order_id", "tcp_seq", "t3", at("t3").alias("at")).withWatermark("at", late)
    return timed.groupBy("session_id", "src_ip", "src_port").transformWithStateInPandas(FlowBuffer(), "session_id string, src_ip long, src_port long, order_id string, eff_t3 long", "Append", "EventTime")


def late_counts(events: DataFrame, released: DataFrame) -> DataFrame:
    """Of each session the records at or above the released time, and those below, which are counted and dropped."""
    joined = events.join(F.broadcast(released), "session_id", "left")
    late = F.coalesce(F.col("t7") < F.col("released_ns"), F.lit(False))
    return joined.groupBy("session_id").agg(F.count_if(~late).alias("kept"), F.count_if(late).alias("late"))


def apply_board_update(board: DataFrame, update: DataFrame) -> DataFrame:
    """Rows replaced by (group, contestant) or appended; columns that the update lacks, or has as null, stay."""
    keys = ["run_group_id", "contestant_id"]
    both = board.alias("b").join(update.alias("u"), keys, "full_outer")
    cols = [F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}")).alias(c) if c in update.columns else F.col(f"b.{c}") for c in board.columns if c not in keys]
    return both.select(*keys, *cols)


def live_metrics(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each session and contestant."""
    rest = [c for c in snapshots.columns if c not in ("session_id", "contestant_id")]
    return snapshots.groupBy("session_id", "contestant_id").agg(F.max_by(F.struct(*rest), F.struct("time_ns", "wave")).alias("s")).select("session_id", "contestant_id", "s.*")


def ready_groups(runs: DataFrame, progress: DataFrame, scores: DataFrame, sessions: int = 4) -> DataFrame:
    """Groups with all sessions there, ended and graded, and no score yet; the same query serves either stream and the scan at startup."""
    joined = runs.join(progress.select("session_id", F.col("status").alias("ended"), "correctness_score"), "session_id", "left")
    whole = joined.groupBy("run_group_id").agg(F.count_distinct("session_id").alias("n"), F.bool_and(F.coalesce(F.col("ended").isin("completed", "failed"), F.lit(False))).alias("ended"), F.bool_and(F.col("correctness_score").isNotNull()).alias("graded"))
    return whole.where((F.col("n") == sessions) & F.col("ended") & F.col("graded")).select("run_group_id").join(scores.select("run_group_id"), "run_group_id", "left_anti")
