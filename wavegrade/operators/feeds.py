"""Registered queries of the sources, sinks and streaming jobs. Each writes what it reads back, or drains a stream, and has an oracle statement straight from the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrade import schemas
from wavegrade.operators import intime, ordering
from wavegrade.sources import io
from wavegrade.sources.views import B, SECOND_NS, WAVE_NS
from wavegrade.streaming import live, sinks

QUERIES, ORACLES = {}, {}
_md5 = "('0x' || substr(md5(order_id), 1, 15))::bigint"


folder, stored = io.scratch, io.stored


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    from wavegrade.plans import catalog

    return catalog.run(spark, sf_dir, sql if " " in sql else f"select * from {sql}")


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def streamed(df: DataFrame, batches: int = 0) -> DataFrame:
    """df as a stream over files; with batches, over so many files of which each makes a batch."""
    path = folder(df.sparkSession)
    (df.repartition(batches) if batches else df).write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(path)


#: Rows of a stream that a batch takes, about, and files that hold them, a task for each.
BATCH_ROWS, BATCH_FILES = 3_000_000, 12


def in_step(*sides: tuple[DataFrame, str], mark: bool = False) -> list[DataFrame]:
    """Streams over files in the order of a time column, each of as many batches as the greatest of them needs: they advance together, and
    a watermark lets a batch's rows go while the next come, so that state is bounded by batches and not by the input. mark: with end marks,
    an hour after the last event of all sides, so that a side without rows holds nothing back. The files are all that is written: a side is
    computed once for its number of rows and its last time, and once more to be sorted."""
    known = [df.agg(F.count("*"), F.max(time)).first() for df, time in sides]
    batches = max(1, *(-(-n // BATCH_ROWS) for n, _ in known))
    last, streams = max((t for _, t in known if t is not None), default=None), []
    for df, time in sides:
        path, rows, reader = folder(df.sparkSession), df.unionByName(end_mark(df, df.sparkSession.range(1).select(F.lit(last).cast("long").alias(time)))) if mark else df, df.sparkSession.readStream.schema(df.schema)
        with io.settings(df.sparkSession, io.FREED):
            (rows.repartitionByRange(batches * BATCH_FILES, time) if batches > 1 else rows).write.parquet(path)
        if batches > 1 and io.told_in_order(df.sparkSession, path):
            reader = reader.option("maxFilesPerTrigger", BATCH_FILES)
        streams.append(reader.parquet(path))
    return streams


def twice(sink):
    """The sink as Spark may call it: every batch comes again with its number."""

    def again(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    return again


_json = lambda df, *cols: df.select(F.to_json(F.struct(*cols)).alias("value"))


@query("select session_id, contestant_id, barrier_epoch_ns, order_id, t0, t1, r9, timed_out, price, qty, side, payload_type, ord_type, orig_order_id, smp_id from orders_sent")
def S01_read_sent(spark, sf_dir):
    batches = stored(io.to_batches(view(spark, sf_dir, "orders_sent"), ["session_id", "contestant_id", "barrier_epoch_ns"]))
    return io.read_sent(batches).drop("task_id")


@query("select session_id, order_id, src_ip, src_port, tcp_seq, t3, t7, exec_type, fill_qty, fill_price, liquidity_ind from orders_acked")
def S02_read_acked(spark, sf_dir):
    return io.read_acked(stored(io.to_batches(view(spark, sf_dir, "orders_acked"), ["session_id", "contestant_id"]))).drop("contestant_id")


@query("select entity_id as session_id, run_status as status, cast(event_id as bigint) as at_ns from status_events")
def S03_read_status(spark, sf_dir):
    values = _json(view(spark, sf_dir, "status_events"), F.col("entity_id").alias("session_id"), F.col("run_status").alias("status"), F.lit("").alias("message"), F.col("event_id").alias("at_ns"))
    return io.decoded(values, schemas.RUN_STATUS).drop("message")


_graded = "select session_id, count(*) filter (where outcome <> 'gap') as scored, count(*) filter (where outcome = 'lost' or filled > qty) as dirty from outcomes group by session_id"


@query(f"select session_id, cast(scored - dirty as double) / scored as correctness_score, scored, dirty from ({_graded}) q")
def S04_read_correctness(spark, sf_dir):
    values = _json(view(spark, sf_dir, _graded), "session_id", ((F.col("scored") - F.col("dirty")).cast("double") / F.col("scored")).alias("correctness_score"), "scored", "dirty", F.lit(1).alias("at_ns"))
    return io.decoded(values, schemas.CORRECTNESS).drop("at_ns")


@query("select session_id, cast(substr(session_id, 2) as int) % 6 as band, scenario_id = 'correctness' as max_rate from runs")
def S05_session_meta(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").crossJoin(spark.range(2).select(F.col("id").alias("at_ns")))
    rate = F.when((F.col("scenario_id") == "correctness") & (F.col("at_ns") == 1), 0).otherwise(300)
    tasks = F.array(*(F.struct(F.lit(k).alias("task_id"), rate.alias("target_rps")) for k in range(3)))
    band = (F.expr("cast(substr(session_id, 2) as int) % 6") + F.when(F.col("at_ns") == 0, 9).otherwise(0)).alias("band")
    return io.session_meta(_json(runs, "session_id", band, tasks.alias("tasks"), "at_ns"))


@query("select run_group_id, contestant_id, cast(place as bigint) as place, peak_sustained_tps from board")
def S06_board_updates(spark, sf_dir):
    return io.decoded(_json(view(spark, sf_dir, "board"), "run_group_id", "contestant_id", "place", "peak_sustained_tps"), schemas.BOARD_UPDATE)


@query(f"select session_id, order_id, t0 from orders_sent where session_id = 's3' and t0 >= {B + 10 * SECOND_NS} and t0 <= {B + 200 * SECOND_NS}")
def S07_scan_session(spark, sf_dir):
    return io.scan_session(stored(view(spark, sf_dir, "orders_sent")), "s3", B + 70 * SECOND_NS, B + 200 * SECOND_NS).select("session_id", "order_id", "t0")


@query(f"select session_id, order_id from orders_acked where {_md5} % 24 in (20, 21, 22, 23, 0, 1, 2, 3, 4, 5)")
def S08_band(spark, sf_dir):
    acked = view(spark, sf_dir, "orders_acked").withColumn("part", io.shard(F.col("order_id"), 24))
    return acked.where(F.col("part").isin(io.band_partitions(2, 10, 24))).select("session_id", "order_id")


@query("select case when event_id % 17 = 0 then 'undecodable' when entity_id <> 'k7' then 'foreign' else 'good' end as kind, count(*) as n from status_events group by 1")
def S09_split_bad(spark, sf_dir):
    events = view(spark, sf_dir, "status_events")
    good = F.to_json(F.struct(F.col("entity_id").alias("session_id"), F.col("run_status").alias("status"), F.col("event_id").alias("at_ns")))
    kept, bad = io.split_bad(events.select(F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(good).alias("value")), schemas.RUN_STATUS, "k7")
    return kept.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("good").alias("kind"), "n").unionByName(bad.select(F.col("reason").alias("kind"), "n"))


_seconds = f"select session_id, wave, t0 - t0 % {SECOND_NS} as second_ns, count(*) as offered, count(*) filter (where timed_out) as errors from sent_waves group by session_id, wave, t0 - t0 % {SECOND_NS}"


@query(f"select cast(floor(second_ns / {3600 * SECOND_NS}) as bigint) as event_hour, 2 * count(*) as n, cast(2 * sum(offered) as bigint) as offered from ({_seconds}) q group by 1")
def S10_partial_rows(spark, sf_dir):
    path, rows = folder(spark), view(spark, sf_dir, _seconds)
    io.write_partial(rows, path)
    io.write_partial(rows, path)
    return spark.read.parquet(path).groupBy(F.col("event_hour").cast("long").alias("event_hour")).agg(F.count("*").alias("n"), F.sum("offered").alias("offered"))


_waves = "select session_id, wave, offered, timed_out as errors from window_counters"


@query(f"select session_id, wave, case when wave % 2 = 0 then offered + 7 else offered end as offered, errors from ({_waves}) q union all select session_id, -1, 1, 1 from ({_waves}) q where wave = 0")
def S11_upsert(spark, sf_dir):
    target = view(spark, sf_dir, _waves)
    fresh = target.where("wave % 2 = 0").withColumn("offered", F.col("offered") + 7).unionByName(target.where("wave = 0").select("session_id", F.lit(-1).cast("long").alias("wave"), F.lit(1).cast("long").alias("offered"), F.lit(1).cast("long").alias("errors")))
    return io.upsert(target, fresh, ["session_id", "wave"])


_shots = f"select r.contestant_id, m.session_id, m.wave, m.p99, m.wave * {WAVE_NS} + k * 1000000000 as time_ns, k from metrics m join runs r on r.session_id = m.session_id join (select n_nationkey as k from nation where n_nationkey < 3) n on k <= m.wave"


@query(f"select contestant_id, session_id, wave, p99, k, time_ns, wave = max(wave) over (partition by session_id) as live from (select s.*, row_number() over (partition by contestant_id, session_id, wave order by time_ns desc) as nth from ({_shots}) s where time_ns >= {2 * WAVE_NS}) q where nth = 1")
def S12_live_view(spark, sf_dir):
    return io.live_view(view(spark, sf_dir, _shots), 3602 * SECOND_NS + 2 * WAVE_NS - 2 * SECOND_NS, 3600 * SECOND_NS)


_old = "select session_id, case when cast(substr(session_id, 2) as int) % 2 = 0 then 'timed_out' else 'scored' end as status, cast(1 as bigint) as scored from runs where cast(substr(session_id, 2) as int) < 12"
_new = f"select session_id, case when cast(substr(session_id, 2) as int) % 3 = 0 then 'timed_out' else 'scored' end as status, scored from ({_graded}) q where session_id <> 's1'"
_claims = f"select coalesce(o.session_id, n.session_id) as session_id, case when w then n.status else o.status end as status, case when w then n.scored else o.scored end as scored, w as claimed from (select o.session_id as os, n.session_id as ns, n.session_id is not null and (o.session_id is null or (o.status = 'timed_out' and n.status = 'scored')) as w from ({_old}) o full outer join ({_new}) n on n.session_id = o.session_id) k left join ({_old}) o on o.session_id = os left join ({_new}) n on n.session_id = ns"


@query(_claims)
def S13_claim_upsert(spark, sf_dir):
    return io.claim_upsert(view(spark, sf_dir, _old), view(spark, sf_dir, _new))


@query(f"select coalesce(s.session_id, c.session_id) as session_id, status, scored, dirty from (select session_id, status from runs where session_id <> 's4') s full outer join ({_graded}) c on c.session_id = s.session_id")
def S14_fold_progress(spark, sf_dir):
    status = view(spark, sf_dir, "runs").where("session_id <> 's4'").select("session_id", "status", F.lit(2).alias("at_ns"))
    older = status.select("session_id", F.lit("queued").alias("status"), F.lit(1).alias("at_ns"))
    graded = view(spark, sf_dir, _graded).select("session_id", F.lit(0.5).alias("correctness_score"), "scored", "dirty", F.lit(1).alias("at_ns"))
    return io.fold_progress(older.unionByName(status), graded).drop("correctness_score")


@query("select run_group_id, team_name from scores where not disqualified")
def S15_insert_absent(spark, sf_dir):
    scores = view(spark, sf_dir, "scores")
    return io.insert_absent(scores.where("disqualified"), scores, "run_group_id").select("run_group_id", "team_name")


@query(f"select session_id as key, concat(chr(123), '\"dirty\":', dirty, ',\"scored\":', scored, ',\"session_id\":\"', session_id, '\"', chr(125)) as value from ({_graded}) q")
def S16_publish_correctness(spark, sf_dir):
    return io.to_kafka(view(spark, sf_dir, _graded), "session_id")


@query("select run_group_id as key, concat(chr(123), '\"place\":', place, ',\"run_group_id\":\"', run_group_id, '\"', chr(125)) as value from board")
def S17_publish_board(spark, sf_dir):
    return io.to_kafka(view(spark, sf_dir, "select run_group_id, place from board"), "run_group_id")


@query("select s_suppkey, s_name from supplier")
def S18_read_table(spark, sf_dir):
    return io.read_table(spark, f"{sf_dir}/supplier.parquet", ["s_suppkey", "s_name"])


@query("select scenario as scenario_id, cast(row_number() over (partition by scenario order by task_id) - 1 as int) as place, task_id, target_rps from tasks")
def S19_explode_tasks(spark, sf_dir):
    specs = view(spark, sf_dir, "tasks").groupBy(F.col("scenario").alias("scenario_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("task_id", "target_rps")))).alias("task_specs"))
    return io.explode_tasks(specs)


@query("select run_group_id, place from board")
def S20_export(spark, sf_dir):
    path = folder(spark)
    io.export({"board": view(spark, sf_dir, "select run_group_id, place from board"), "runs": view(spark, sf_dir, "runs")}, path)
    return spark.read.parquet(f"{path}/board")


_curve = "select cast(bucket_hi as bigint) as value, cast(cum as bigint) as total, metric from cumulative where wave = 0"


@query(f"select value, cast(1.0 as double) as percentile, total from ({_curve}) q")
def S21_percentile_file(spark, sf_dir):
    path = folder(spark)
    io.export_hgrm(view(spark, sf_dir, _curve).withColumn("percentile", F.lit(1.0).cast("double")), path)
    return spark.read.option("sep", " ").schema("value long, percentile double, total long").csv(path)


@query(f"select session_id, wave, 2 * count(*) as n from ({_waves}) q group by session_id, wave")
def S22_tsv(spark, sf_dir):
    path, rows = folder(spark), view(spark, sf_dir, _waves)
    io.write_tsv(rows, path)
    io.write_tsv(rows, path)
    return spark.read.option("sep", "\t").schema(rows.schema).csv(path).groupBy("session_id", "wave").agg(F.count("*").alias("n"))


@query("select name, cast(label as varchar) as label, count(*) as n, max(counter_value) as top from metric_samples group by name, label")
def S23_metric_samples(spark, sf_dir):
    samples = io.read_samples(view(spark, sf_dir, "metric_samples").withColumnRenamed("counter_value", "value"))
    return stored(samples).groupBy("name", F.col("labels")["label"].alias("label")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("select service_name, level, http_path, count(*) as n from logs group by service_name, level, http_path")
def S24_logs(spark, sf_dir):
    lines = view(spark, sf_dir, "logs").select("ts", "service_name", F.to_json(F.struct("level", "http_path")).alias("line"))
    return io.read_logs(lines).groupBy("service_name", "level", "http_path").agg(F.count("*").alias("n"))


@query(f"select cast(shard as int) as shard, sum(sent) as sent, sum(acked) as acked from (select {_md5} % 6 as shard, 1 as sent, 0 as acked from orders_sent union all select {_md5} % 6, 0, 1 from orders_acked) q group by shard")
def S25_sharded_write(spark, sf_dir):
    counts = []
    for name in ("orders_sent", "orders_acked"):
        path = folder(spark)
        io.write_sharded(view(spark, sf_dir, name), path, 6)
        counts.append(spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias(name[7:])))
    return counts[0].join(counts[1], "shard", "full_outer").select("shard", F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("acked", F.lit(0)).alias("acked"))


@query("select session_id, wave, count(*) as offered, count(*) filter (where timed_out) as timed_out from sent_waves group by session_id, wave")
def T01_wave_windows(spark, sf_dir):
    return live.run(live.wave_counts(streamed(view(spark, sf_dir, "orders_sent"))), folder(spark), "complete")


@query(_seconds)
def T02_interval_counters(spark, sf_dir):
    return live.run(live.interval_counts(streamed(view(spark, sf_dir, "orders_sent"))), folder(spark), "complete")


_windows = f"select session_id, contestant_id, t0 // {WAVE_NS} * 20 as start_s from orders_sent"


@query(f"select session_id, start_s, count(*) as n, max(contestant_id) as contestant_id from ({_windows}) q where (start_s + 20) * {SECOND_NS} <= (select max(t0) from orders_sent) - {30 * SECOND_NS} group by session_id, start_s")
def T03_idle_windows(spark, sf_dir):
    return live.run(live.closed_windows(streamed(view(spark, sf_dir, "orders_sent"))), folder(spark))


@query("select distinct session_id, order_id from orders_acked")
def T04_first_response_memory(spark, sf_dir):
    return live.run(live.first_responses(streamed(view(spark, sf_dir, "orders_acked"))), folder(spark)).select("session_id", "order_id")


@query("select a.session_id, s.timed_out, count(*) as n from orders_acked a join orders_sent s on s.session_id = a.session_id and s.order_id = a.order_id group by a.session_id, s.timed_out")
def T05_timed_out_marker(spark, sf_dir):
    sent, acked = in_step((view(spark, sf_dir, "select session_id, order_id, t0, timed_out from orders_sent"), "t0"), (view(spark, sf_dir, "select session_id, order_id, t3, t7, exec_type from orders_acked"), "t3"))
    return live.run(live.answers_in_time(sent, acked), folder(spark), most_parts=2 * BATCH_FILES).groupBy("session_id", "timed_out").agg(F.count("*").alias("n"))


@query(f"select session_id, max(contestant_id) as contestant_id, count(*) as windows from (select distinct session_id, contestant_id, start_s from ({_windows}) q where (start_s + 20) * {SECOND_NS} <= (select max(t0) from orders_sent) - {30 * SECOND_NS}) z group by session_id")
def T06_session_metadata(spark, sf_dir):
    closed = live.run(live.closed_windows(streamed(view(spark, sf_dir, "orders_sent"))), folder(spark))
    return closed.groupBy("session_id").agg(F.max("contestant_id").alias("contestant_id"), F.count("*").alias("windows"))


@query(f"select session_id, second_ns // {SECOND_NS} as second_s, cast(sum(offered) as bigint) as offered, cast(sum(errors) as bigint) as errors from ({_seconds}) q where second_ns + {SECOND_NS} <= (select max(t0 - t0 % {SECOND_NS}) from orders_sent) - {3 * SECOND_NS} group by session_id, second_ns")
def T07_sealed_rollup(spark, sf_dir):
    return live.run(live.sealed_seconds(streamed(view(spark, sf_dir, _seconds))), folder(spark))


@query("select session_id, wave, offered, timed_out as errors from (select session_id, wave, count(*) as offered, count(*) filter (where timed_out) as timed_out from sent_waves group by session_id, wave) q")
def T08_reroll(spark, sf_dir):
    rows = view(spark, sf_dir, _seconds).drop("second_ns")
    fresh, history = rows.where("wave % 3 = 1"), rows.where("wave % 3 <> 1")
    stale = history.groupBy("session_id", "wave").agg(F.sum("offered").alias("offered"), F.sum("errors").alias("errors"))
    wrong = fresh.select("session_id", "wave").distinct().select("session_id", "wave", F.lit(0).cast("long").alias("offered"), F.lit(0).cast("long").alias("errors"))
    return live.reroll(stale.unionByName(wrong), history, fresh)


@query("select a.session_id, count(*) as n, cast(sum(fill_qty) as bigint) as filled from orders_acked a join orders_sent s on s.session_id = a.session_id and s.order_id = a.order_id and a.t3 // 1000 >= s.t0 // 1000 and a.t3 // 1000 <= s.t0 // 1000 + 500000 group by a.session_id")
def T09_join_window(spark, sf_dir):
    sent, acked = in_step((view(spark, sf_dir, "select session_id, order_id, t0 from orders_sent"), "t0"), (view(spark, sf_dir, "select session_id, order_id, t3, t7, exec_type, fill_qty from orders_acked"), "t3"))
    return live.run(live.matched_in_window(sent, acked), folder(spark), most_parts=2 * BATCH_FILES).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("fill_qty").alias("filled"))


# Answers of some orders at 499 and 501 ms after them.
_late = "select session_id, order_id, exec_type, fill_qty, fill_price, t3 + late as t3, t7 + late as t7 from (select a.*, case cast(order_id as bigint) % 97 when 5 then 498000000 when 6 then 500000000 else 0 end as late from orders_acked a) q"
_in_time = f"""select session_id, order_id, case when sent and count(t3) > 0 then 'matched' when sent and bool_or(timed_out) then 'lost' when sent then 'gap' when bool_or(fill_qty > 0 and exec_type in ('1', '2', 'F')) then 'phantom' else 'unsent' end as outcome, count(t3) as n_acks, cast(coalesce(sum(fill_qty), 0) as bigint) as filled
from (select coalesce(s.session_id, a.session_id) as session_id, coalesce(s.order_id, a.order_id) as order_id, s.order_id is not null as sent, s.timed_out, a.t3, a.fill_qty, a.exec_type
  from orders_sent s full outer join (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from ({_late}) l) a on a.session_id = s.session_id and a.order_id = s.order_id and a.t3 >= s.t0 and a.t3 <= s.t0 + 500000000) q
group by session_id, order_id, sent"""


def ended(df: DataFrame, *times: str) -> DataFrame:
    """df with an end mark, an hour after its last event: it moves the watermark past all of them."""
    return df.unionByName(end_mark(df, df.agg(*(F.max(t).alias(t) for t in times))))


def end_mark(df: DataFrame, last: DataFrame) -> DataFrame:
    """The end mark of df, from one row with the last of its times. Its other columns are empty, not null, as joins drop null keys before the watermark sees them."""
    blank = lambda f: F.lit("" if f.dataType.typeName() == "string" else False if f.dataType.typeName() == "boolean" else 0).cast(f.dataType)
    return last.select(*((F.col(f.name) + 3600 * SECOND_NS if f.name in last.columns else blank(f)).alias(f.name) for f in df.schema))


@query(_in_time)
def J01_in_time(spark, sf_dir):
    return intime.outcomes(view(spark, sf_dir, "orders_sent"), view(spark, sf_dir, _late))


@query(_in_time)
def T09_outcomes_in_time(spark, sf_dir):
    """The stream of J01_in_time."""
    sent, acked = in_step((view(spark, sf_dir, "select session_id, order_id, t0, timed_out from orders_sent"), "t0"), (view(spark, sf_dir, _late), "t3"), mark=True)
    told = intime.told(live.outcomes_in_time(sent, acked)).where("session_id <> ''")  # no more of a pair is written than its outcome needs
    return intime.counted(live.run(told, folder(spark), most_parts=2 * BATCH_FILES))


# Answers of some orders come six seconds late: their requests are evicted before.
_slow = f"select session_id, order_id, t7 + case when cast(order_id as bigint) % 41 = 3 then {6 * SECOND_NS} else 0 end as t7 from orders_acked"


@query(f"select s.session_id, s.order_id, min(a.t7) - min(s.t1) as first_ns, count(a.t7) as answers, count(a.t7) = 0 as evicted from orders_sent s left join ({_slow}) a on a.session_id = s.session_id and a.order_id = s.order_id and a.t7 // 1000 between s.t1 // 1000 and s.t1 // 1000 + 5000000 group by s.session_id, s.order_id")
def T12_in_flight(spark, sf_dir):
    requests, responses = in_step((view(spark, sf_dir, "select session_id, order_id, t1 as t3 from orders_sent"), "t3"), (view(spark, sf_dir, _slow), "t7"), mark=True)
    pairs = live.run(live.answered_or_evicted(requests, responses), folder(spark), most_parts=2 * BATCH_FILES)
    return pairs.where("session_id <> ''").groupBy("session_id", "order_id").agg((F.min("t7") - F.min("t3")).alias("first_ns"), F.count("t7").alias("answers"), (F.count("t7") == 0).alias("evicted"))


@query("select session_id, order_id, max(t3) over (partition by session_id, src_ip, src_port order by tcp_seq, cast(order_id as bigint)) as eff_t3 from (select session_id, order_id, src_ip, src_port, tcp_seq, min(t3) as t3 from orders_acked group by all) q")
def T10_arrival_order(spark, sf_dir):
    """Shuffled input: the files' rows lie by a hash of their order."""
    one = view(spark, sf_dir, "select session_id, order_id, src_ip, src_port, tcp_seq, min(t3) as t3 from orders_acked group by session_id, order_id, src_ip, src_port, tcp_seq")
    one = stored(one.withColumn("src_ip", F.col("src_ip").cast("long")).withColumn("src_port", F.col("src_port").cast("long")))  # else the end mark and the sort would each find them anew
    found = live.run(live.in_arrival_order(streamed(ended(one.orderBy(F.xxhash64("order_id")), "t3"))), folder(spark))
    return found.where("session_id <> ''").select("session_id", "order_id", "eff_t3")


_flows = "(select session_id, order_id, src_ip, src_port, tcp_seq, min(t3) as t3, min(t7) as min_t7 from orders_acked group by all)"
_steps = f"(select *, src_ip * 65536 + src_port as flow, row_number() over (partition by session_id order by min_t7, eff_t3, src_ip, src_port, tcp_seq, order_id::bigint) as step from (select *, max(t3) over (partition by session_id, src_ip, src_port order by tcp_seq, order_id::bigint) as eff_t3 from {_flows} f) e)"
_pairs = f"select a.session_id, a.order_id, any_value(a.t3) as t3, max(b.t3) as other_t3 from {_steps} a left join {_steps} b on b.session_id = a.session_id and b.step < a.step and b.flow <> a.flow group by a.session_id, a.order_id"


@query(f"select session_id, order_id, eff_t3, row_number() over (partition by session_id order by eff_t3, src_ip, src_port, tcp_seq, order_id::bigint) as nth from {_steps} q")
def W05_replay_order(spark, sf_dir):
    return ordering.replay_order(view(spark, sf_dir, "orders_acked")).select("session_id", "order_id", "eff_t3", "nth")


@query(f"select session_id, order_id from (select *, lag(tcp_seq) over (partition by session_id, flow order by step) as before from {_steps} q) z where (tcp_seq - before + 2147483648 + 4294967296) % 4294967296 - 2147483648 <= 0")
def W06_flow_order(spark, sf_dir):
    return ordering.flow_breaches(view(spark, sf_dir, "orders_acked"))


@query(f"select session_id, order_id, other_t3 from ({_pairs}) q")
def W07_cross_flow(spark, sf_dir):
    return ordering.cross_flow(view(spark, sf_dir, "orders_acked")).drop("t3")


@query(f"select session_id, order_id, coalesce(other_t3 > t3, false) as inversion, case when other_t3 > t3 then other_t3 - t3 else 0 end as jitter_ns, coalesce(other_t3 - t3 > 500000, false) as violation from ({_pairs}) q")
def P21_cross_flow_predicate(spark, sf_dir):
    return ordering.jitter(view(spark, sf_dir, "orders_acked"))


_at = lambda q: f"cast(1::bigint << (list_sort(list(length(bin(other_t3 - t3))) filter (where other_t3 > t3))[cast(floor({q} * (count(*) filter (where other_t3 > t3) - 1)) as bigint) + 1] - 1) as bigint)"
_stats = f"select session_id, count(*) filter (where other_t3 > t3) as n, max(other_t3 - t3) filter (where other_t3 > t3) as top_ns, cast(count(*) filter (where other_t3 > t3) as double) / count(*) as rate, {_at(0.5)} as p50, {_at(0.99)} as p99, {_at(0.999)} as p999 from ({_pairs}) q group by session_id having count(*) filter (where other_t3 > t3) > 0"


@query(_stats)
def A24_jitter_stats(spark, sf_dir):
    return ordering.jitter_stats(view(spark, sf_dir, "orders_acked"))


@query(f"select run_group_id, max(p50) as p50, max(p99) as p99, max(p999) as p999, max(top_ns) as top_ns, max(rate) as rate from ({_stats}) s join runs r on r.session_id = s.session_id group by run_group_id")
def A14_worst_jitter(spark, sf_dir):
    return ordering.worst_jitter(ordering.jitter_stats(view(spark, sf_dir, "orders_acked")), view(spark, sf_dir, "runs"))


_released = "select session_id, min(t7) + 5000000000 as released_ns from orders_acked group by session_id"


@query(f"select a.session_id, count(*) filter (where t7 >= released_ns) as kept, count(*) filter (where t7 < released_ns) as late from orders_acked a join ({_released}) r on r.session_id = a.session_id group by a.session_id")
def T11_late_count(spark, sf_dir):
    return live.run(live.late_counts(streamed(view(spark, sf_dir, "orders_acked")), view(spark, sf_dir, _released)), folder(spark), "complete")


@query(f"select session_id, status, scored, false as claimed from ({_claims}) q")
def T13_effect_once(spark, sf_dir):
    """The same source a second time changes nothing and claims nothing."""
    once = io.claim_upsert(view(spark, sf_dir, _old), view(spark, sf_dir, _new)).drop("claimed")
    return io.claim_upsert(once, view(spark, sf_dir, _new))


@query(f"select session_id, 'scored' as status, scored from ({_graded}) q")
def T14_placeholder_upgrade(spark, sf_dir):
    """Placeholders for all sessions, then scores, then placeholders again, which change nothing."""
    scored = view(spark, sf_dir, _graded).select("session_id", F.lit("scored").alias("status"), "scored")
    blank = scored.select("session_id", F.lit("timed_out").alias("status"), F.lit(0).cast("long").alias("scored"))
    return io.claim_upsert(io.claim_upsert(blank, scored).drop("claimed"), blank).drop("claimed")


@query("select run_group_id, contestant_id, team_name, case when disqualified then peak_sustained_tps + 1 else peak_sustained_tps end as peak_sustained_tps from scores union all select concat(run_group_id, 'x'), contestant_id, null, peak_sustained_tps from scores where disqualified")
def T16_board_update(spark, sf_dir):
    board = view(spark, sf_dir, "scores").select("run_group_id", "contestant_id", "team_name", "peak_sustained_tps")
    hit = view(spark, sf_dir, "scores").where("disqualified").select("run_group_id", "contestant_id", "peak_sustained_tps")
    update = hit.withColumn("peak_sustained_tps", F.col("peak_sustained_tps") + 1).unionByName(hit.withColumn("run_group_id", F.concat("run_group_id", F.lit("x"))))
    return live.apply_board_update(board, update)


@query(f"select session_id, contestant_id, wave, p99, time_ns from (select s.*, row_number() over (partition by session_id, contestant_id order by time_ns desc, wave desc) as nth from ({_shots}) s) q where nth = 1")
def T17_live_metrics(spark, sf_dir):
    return live.live_metrics(view(spark, sf_dir, _shots)).drop("k")


@query("select run_group_id from (select run_group_id, bool_and(status in ('completed', 'failed')) as ended from runs group by run_group_id) q where ended and run_group_id <> 'g1'")
def T18_ready_trigger(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    graded = view(spark, sf_dir, _graded).select("session_id", F.lit(0.5).alias("correctness_score"), "scored", "dirty", F.lit(1).alias("at_ns"))
    progress = io.fold_progress(runs.select("session_id", "status", F.lit(1).alias("at_ns")), graded)
    return live.ready_groups(runs.select("session_id", "run_group_id"), progress, runs.where("run_group_id = 'g1'"))


_seconds_schema = "session_id string, wave long, second_ns long, offered long, errors long"


@query(_seconds)
def S10_append_once(spark, sf_dir):
    """Partial rows through a sink that gets every batch twice."""
    rows, path = view(spark, sf_dir, _seconds), folder(spark)
    schema = _seconds_schema + ", batch_id long"
    sinks.drain(streamed(rows, 3), twice(sinks.appending(path, schema)), folder(spark))
    return sinks.table(spark, path, schema).drop("batch_id")


@query(f"select session_id, wave, max(second_ns) as second_ns, arg_max(offered, second_ns) as offered, arg_max(errors, second_ns) as errors from ({_seconds}) q group by session_id, wave")
def S11_upsert_stream(spark, sf_dir):
    """The newest second of each wave, from batches with several rows of a key, each batch twice; rows go by session."""
    path = folder(spark)
    newest = sinks.merging(path, _seconds_schema, ["session_id"], lambda old, new, _: io.newest(old.unionByName(new.select(*old.columns)), ["session_id", "wave"], ["second_ns"]))
    sinks.drain(streamed(view(spark, sf_dir, _seconds), 3), twice(newest), folder(spark))
    return sinks.table(spark, path, _seconds_schema)


_claim_schema = "session_id string, status string, scored long, claimed_by long"


@query(f"select coalesce(n.session_id, o.session_id) as session_id, case when n.session_id is not null and (o.session_id is null or (o.status = 'timed_out' and n.status = 'scored')) then n.status else o.status end as status, case when n.session_id is not null and (o.session_id is null or (o.status = 'timed_out' and n.status = 'scored')) then n.scored else o.scored end as scored, n.session_id is not null and (o.session_id is null or (o.status = 'timed_out' and n.status = 'scored')) as claimed from ({_old}) o full outer join ({_new}) n on n.session_id = o.session_id")
def T13_claims_stream(spark, sf_dir):
    """Claims in three batches, each given twice, over rows that an earlier batch (-1) left."""
    path = folder(spark)
    sinks.put(view(spark, sf_dir, _old).withColumn("claimed_by", F.lit(-1).cast("long")), path, ["session_id"])
    sinks.drain(streamed(view(spark, sf_dir, _new), 3), twice(sinks.claiming(path, _claim_schema, ["session_id"])), folder(spark))
    return sinks.table(spark, path, _claim_schema).select("session_id", "status", "scored", (F.col("claimed_by") >= 0).alias("claimed"))


@query("select run_group_id, team_name from scores")
def S15_insert_stream(spark, sf_dir):
    """Every row twice in the source, every batch twice; half of the groups are there before."""
    path, schema = folder(spark), "run_group_id string, team_name string, shard int"
    rows = view(spark, sf_dir, "scores").select("run_group_id", "team_name", io.shard(F.col("run_group_id"), 4).cast("int").alias("shard"))
    sinks.put(rows.where("crc32(run_group_id) % 2 = 0"), path, ["shard"])
    sinks.drain(streamed(rows.unionByName(rows), 2), twice(sinks.inserting(path, schema, ["shard"], "run_group_id")), folder(spark))
    return sinks.table(spark, path, schema).drop("shard")


@query("select session_id, wave, count(*) as offered, count(*) filter (where timed_out) as errors from sent_waves group by session_id, wave")
def T08_reroll_stream(spark, sf_dir):
    history, metrics = folder(spark), folder(spark)
    roll = sinks.rerolling(history, _seconds_schema + ", batch_id long", metrics, "session_id string, wave long, offered long, errors long", ["session_id", "wave"], ["offered", "errors"])
    sinks.drain(streamed(view(spark, sf_dir, _seconds), 2), twice(roll), folder(spark))
    return sinks.table(spark, metrics, "session_id string, wave long, offered long, errors long")
