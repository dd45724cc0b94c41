"""Registered queries of rollups by bucket maps, minute calendars, nested answers, storage layouts and folds, with oracles from the raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegrade.operators import alerts, intime, nested, rollup, violations
from wavegrade.operators.feeds import _in_time, _late, _md5, _pairs, _steps, folder, query, view
from wavegrade.sources import io
from wavegrade.sources.views import B, SECOND_NS, WAVE_NS

_by = "session_id, wave, shard"
_counts = f"""
select {_by}, case when wave % 4 = 2 and shard = 1 and second_ns >= {B} + wave * {WAVE_NS} + {WAVE_NS // 2} then 1 else 0 end as run, second_ns, bucket_hi, count(*) as n, count(*) filter (where exec_type = '8') as errors
from (select session_id, wave, case when cast(order_id as bigint) % 7 < 4 then 0 when cast(order_id as bigint) % 7 < 6 then 1 else 2 end as shard, t7 - t7 % {2 * SECOND_NS} as second_ns, exec_type, ((v >> b) << b) + (cast(1 as bigint) << b) - 1 as bucket_hi
  from (select a.*, greatest(t7 - t3, 1) as v, cast(greatest(length(bin(greatest(t7 - t3, 1) | 2047)) - 11, 0) as int) as b from first_acks a) p) q
group by {_by}, second_ns, bucket_hi"""
_epoch = 1704067200  # the sample events begin here; their times are taken twelve times as dense
_samples = """
select name, label, at_s, event_id, cast(sum(v) over (partition by name, label, at_s - at_s % 7200 order by at_s, event_id rows between unbounded preceding and current row) as bigint) as value
from (select event_type as name, cast(user_id % 2 as bigint) as label, {at} as at_s, event_id, cast(round(value * 100) as bigint) as v from events) q"""

VIEWS = {
    # Ticks of two seconds, in which a session has some five answers. Shards are uneven, so that the third is often silent; the process of
    # shard 1 begins anew in the middle of each fourth wave.
    "shard_counts": _counts,
    "counter_samples": _samples.format(at=f"{_epoch} + (unix_timestamp(ts) - {_epoch}) div 12"),
    "group_sessions": """
select s.session_id, s.run_group_id, g.created_at, s.status, case s.n % 4 when 0 then 'constant' when 1 then 'spike' when 2 then 'ramp' else 'correctness' end as scenario_id
from (select entity_id as session_id, concat('g', cast(cast(substr(entity_id, 2) as bigint) % 40 as string)) as run_group_id, cast(substr(entity_id, 2) as bigint) as n, max_by(run_status, event_id) as status from status_events group by entity_id) s
join (select concat('g', cast(cast(substr(entity_id, 2) as bigint) % 40 as string)) as run_group_id, min(event_id) as created_at from status_events group by 1) g on g.run_group_id = s.run_group_id""",
    "graded_fills": """
select session_id, cast(count(*) filter (where liquidity_ind = 1) as double) / count(*) as correctness_score, count(*) filter (where liquidity_ind = 1) as valid_fills, count(*) as total_fills
from live_acks where is_fill and session_id not in ('s5', 's11', 's17') group by session_id""",
    "group_violations": "select r.run_group_id, o.outcome as kind, count(*) as n from outcomes o join runs r on r.session_id = o.session_id where o.outcome <> 'matched' and r.run_group_id <> 'g3' group by r.run_group_id, o.outcome",
    # Some orders' answers come six seconds late: with a cap of five they can't be used.
    "slow_acks": f"select session_id, order_id, src_ip, src_port, tcp_seq, t3, t7 + case when cast(order_id as bigint) % 45 = 4 then {6 * SECOND_NS} else 0 end as t7, exec_type, fill_qty, fill_price from orders_acked",
    "submission_events": "select concat(entity_id, '/', cast(event_id % 31 as string)) as submission_id, case when event_id % 17 = 0 then 'paused' else submission_status end as status, event_id div 2 as seen_at from status_events",
    # Sessions with ids that hold their start, an hour apart; a part of their orders lies before it.
    "timed_orders": f"""
select cast(o_orderkey % 20 as bigint) as session_no, cast(o_orderkey as string) as order_id, {B} + (o_orderkey % 20) * {3600 * SECOND_NS} + case when o_orderkey % 50 = 3 then -{90 * SECOND_NS} when o_orderkey % 50 = 23 then -{30 * SECOND_NS} else o_orderkey * 120000000 end as t0 from orders""",
}
_secs = f"select distinct {_by}, run, second_ns from shard_counts"
_on = "{0}.session_id = {1}.session_id and {0}.wave = {1}.wave and {0}.shard = {1}.shard"
ORACLE_VIEWS = {
    "counter_samples": _samples.format(at=f"{_epoch} + (cast(floor(epoch(ts)) as bigint) - {_epoch}) // 12"),
    "submission_events": VIEWS["submission_events"].replace(" div ", " // "),
    "answers_of_sent": "select distinct a.* from slow_acks a where exists (select 1 from orders_sent s where s.session_id = a.session_id and s.order_id = a.order_id)",
    "graded_acks": f"select * from answers_of_sent where t7 >= t3 and t7 - t3 <= {5 * SECOND_NS}",
    "o_fills": "select * from answers_of_sent where fill_qty > 0 and exec_type in ('1', '2', 'F')",
    "o_violations": f"""
select session_id, order_id, 'overfill' as class, cast(fill_qty as varchar) as detail from (select f.*, s.qty, sum(f.fill_qty) over (partition by f.session_id, f.order_id order by t7, exec_type, fill_qty, fill_price rows unbounded preceding) as cum from o_fills f join orders_sent s on s.session_id = f.session_id and s.order_id = f.order_id) c where cum > qty
union all select session_id, order_id, 'time', 'flow' from (select *, lag(tcp_seq) over (partition by session_id, flow order by step) as before from {_steps} q) z where (tcp_seq - before + 2147483648 + 4294967296) % 4294967296 - 2147483648 <= 0
union all select session_id, order_id, 'time', 'cross' from ({_pairs}) p where other_t3 - t3 > 500000
union all select session_id, order_id, case payload_type when 'CANCEL' then 'lost_cancel' else 'lost_order' end, '' from orders_sent s where not exists (select 1 from graded_acks a where a.session_id = s.session_id and a.order_id = s.order_id) and (timed_out or exists (select 1 from slow_acks a where a.session_id = s.session_id and a.order_id = s.order_id))""".replace("from orders_acked group", "from graded_acks group"),
    "o_secs": _secs,
    "o_cum": f"select s.session_id, s.wave, s.shard, s.second_ns, c.bucket_hi, cast(sum(c.n) as bigint) as n from o_secs s join shard_counts c on {_on.format('c', 's')} and c.run = s.run and c.second_ns <= s.second_ns group by all",
    "o_seq": f"select {_by}, second_ns, lag(second_ns) over (partition by {_by} order by second_ns) as prev_ns from o_secs",
    "o_anew": f"select distinct q.session_id, q.wave, q.shard, q.second_ns from o_seq q join o_cum p on {_on.format('p', 'q')} and p.second_ns = q.prev_ns left join o_cum c on {_on.format('c', 'q')} and c.second_ns = q.second_ns and c.bucket_hi = p.bucket_hi where coalesce(c.n, 0) < p.n",
    "o_slices": f"""
select * from (select c.session_id, c.wave, c.shard, c.second_ns, c.bucket_hi, c.n - case when h.wave is null then coalesce(p.n, 0) else 0 end as n
from o_cum c join o_seq q on {_on.format('q', 'c')} and q.second_ns = c.second_ns left join o_anew h on {_on.format('h', 'c')} and h.second_ns = c.second_ns
left join o_cum p on {_on.format('p', 'c')} and p.second_ns = q.prev_ns and p.bucket_hi = c.bucket_hi) d where n > 0""",
    "o_carried": "select s.session_id, s.wave, s.shard, t.second_ns, max(s.second_ns) as from_ns from o_secs s join (select distinct session_id, wave, second_ns from o_secs) t on t.session_id = s.session_id and t.wave = s.wave and s.second_ns <= t.second_ns group by all",
    "o_steps": "select name, label, at_s // 60 as minute, case when prev is null then 0 when value < prev then value else value - prev end as step from (select c.*, lag(value) over (partition by name, label order by at_s, event_id) as prev from counter_samples c) q",
    "o_span": "select name, label, min(minute) as lo, max(minute) as hi from o_steps group by name, label",
    "o_rises": "select s.name, s.label, s.minute + k as minute, cast(sum(step) as bigint) as increase from o_steps s cross join (select unnest(range(5)) as k) r join o_span e on e.name = s.name and e.label = s.label where s.minute + k <= hi group by all",
    "o_up": "select name, label, minute from o_rises where increase > 0",
    "o_calendar": "select name, label, unnest(generate_series(lo, hi)) as minute from o_span",
    "o_silent": "select c.* from o_calendar c where not exists (select 1 from (select distinct name, label, minute + k as minute from o_steps cross join (select unnest(range(30)) as k) r) s where s.name = c.name and s.label = c.label and s.minute = c.minute)",
}


def _stretches(of: str) -> str:
    """Stretches of minutes in a row, by their first and last ones."""
    edge = lambda d: f"select a.* from {of} a where not exists (select 1 from {of} b where b.name = a.name and b.label = a.label and b.minute = a.minute {d} 1)"
    return f"select s.name, s.label, s.minute as since, min(u.minute) as until from ({edge('-')}) s join ({edge('+')}) u on u.name = s.name and u.label = s.label and u.minute >= s.minute group by s.name, s.label, s.minute"


def reported(spark, sf_dir):
    """What the shards report, written once: rollups read it several times."""
    counts = view(spark, sf_dir, "shard_counts").withColumnRenamed("errors", "rejected").withColumn("answered", F.col("n"))
    return io.stored(rollup.partials(counts, ["answered", "rejected"]))


@query("select * from o_slices")
def A05_bucket_slices(spark, sf_dir):
    return rollup.slices(reported(spark, sf_dir)).select("session_id", "wave", "shard", "second_ns", F.explode("slice").alias("bucket_hi", "n"))


@query(f"select k.session_id, k.wave, k.shard, k.second_ns, k.from_ns = k.second_ns as fresh, cast(sum(c.n) as bigint) as n, count(*) as buckets, max(c.bucket_hi) as top from o_carried k join o_cum c on {_on.format('c', 'k')} and c.second_ns = k.from_ns group by all")
def W09_carried_maps(spark, sf_dir):
    rows = rollup.carried(reported(spark, sf_dir))
    return rows.select("session_id", "wave", "shard", "second_ns", "fresh", rollup.total(F.col("cum")).alias("n"), F.size("cum").cast("long").alias("buckets"), F.array_max(F.map_keys("cum")).alias("top"))


_seen = "select session_id, wave, second_ns, bucket_hi, cast(sum(n) over (partition by session_id, wave, second_ns order by bucket_hi) as bigint) as seen, cast(sum(n) over (partition by session_id, wave, second_ns) as bigint) as total from (select session_id, wave, second_ns, bucket_hi, sum(n) as n from ({0}) z group by all) y"
_whole = f"select k.session_id, k.wave, k.second_ns, c.bucket_hi, c.n from o_carried k join o_cum c on {_on.format('c', 'k')} and c.second_ns = k.from_ns"


@query(f"""
select t.session_id, t.wave, t.second_ns, answered, rejected, p50, p90, p99, p999, cum_n, cum_p99
from (select session_id, wave, second_ns, cast(sum(n) as bigint) as answered, cast(sum(errors) as bigint) as rejected from shard_counts group by all) t
join (select session_id, wave, second_ns, {", ".join(f"min(bucket_hi) filter (where seen >= greatest(1, ceil({q} * total))) as {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p999")))} from ({_seen.format("select * from o_slices")}) s group by all) s
on s.session_id = t.session_id and s.wave = t.wave and s.second_ns = t.second_ns
join (select session_id, wave, second_ns, max(total) as cum_n, min(bucket_hi) filter (where seen >= greatest(1, ceil(0.99 * total))) as cum_p99 from ({_seen.format(_whole)}) w group by all) w
on w.session_id = t.session_id and w.wave = t.wave and w.second_ns = t.second_ns""")
def A08_carried_rollup(spark, sf_dir):
    rows = rollup.rolled(reported(spark, sf_dir), ["answered", "rejected"], {"p50": "0.5", "p90": "0.9", "p99": "0.99", "p999": "0.999"})
    return rows.withColumn("cum_n", rollup.total(F.col("cum"))).withColumn("cum_p99", rollup.quantile(F.col("cum"), "0.99")).drop("cum")


_series, _order = ["name", "label"], {"order": ("event_id",)}


@query("select name, minute, cast(sum(increase) as double) / 300 as rate from o_rises group by name, minute")
def M01_rate_5m(spark, sf_dir):
    return alerts.rate(view(spark, sf_dir, "counter_samples"), _series, ["name"], 5, **_order)


@query("select c.name, c.label, c.minute, coalesce(r.increase, 0) as increase from o_calendar c left join o_rises r on r.name = c.name and r.label = c.label and r.minute = c.minute")
def M02_increase_5m(spark, sf_dir):
    return alerts.increase(view(spark, sf_dir, "counter_samples"), _series, 5, 0, **_order)


@query(f"select name, label, since, until, since + 2 as fires from ({_stretches('o_up')}) q where until - since >= 2")
def M07_held_for(spark, sf_dir):
    return alerts.held(alerts.increase(view(spark, sf_dir, "counter_samples"), _series, 5, **_order), _series, 2)


@query(f"select name, label, since, until, case when until - since >= 5 then since + 5 end as fires from ({_stretches('o_silent')}) q")
def M08_absent_30m(spark, sf_dir):
    return alerts.absent(view(spark, sf_dir, "counter_samples"), _series, 30, 5, **_order)


@query("""
select run_group_id, created_at, team_name, string_agg(scenario_id || ':' || session_id || ':' || status, ',' order by sort_order, scenario_id, session_id) as sessions
from (select g.*, c.sort_order, coalesce(t.team_name, '') as team_name from group_sessions g join scenarios c on c.scenario_id = g.scenario_id left join scores t on t.run_group_id = g.run_group_id
  where g.run_group_id in (select run_group_id from group_sessions where status not in ('completed', 'failed')) order by created_at desc, sort_order, g.scenario_id, session_id limit 500) q
group by run_group_id, created_at, team_name""")
def L06_active_groups(spark, sf_dir):
    found = nested.active_runs(view(spark, sf_dir, "group_sessions"), view(spark, sf_dir, "scenarios"), view(spark, sf_dir, "select run_group_id, team_name from scores"))
    return found.withColumn("sessions", F.array_join(F.transform("sessions", lambda s: F.concat_ws(":", s["scenario_id"], s["session_id"], s["status"])), ","))


_line = "session_id, wave, tps_20s, p99"


@query("""
select g.run_group_id, s.peak_sustained_tps as score_peak, v.violations, g.sessions
from (select run_group_id, string_agg(r.scenario_id || ':' || r.session_id || ':' || r.status || ':' || coalesce(cast(f.valid_fills as varchar) || '/' || cast(f.total_fills as varchar), 'ungraded') || '[' || coalesce(m.line, '') || ']', ';' order by c.sort_order, r.scenario_id, r.session_id) as sessions
  from runs r join scenarios c on c.scenario_id = r.scenario_id left join graded_fills f on f.session_id = r.session_id
  left join (select session_id, string_agg(wave || '=' || tps_20s || '/' || p99, ',' order by wave) as line from metrics group by session_id) m on m.session_id = r.session_id group by run_group_id) g
left join published s on s.run_group_id = g.run_group_id
join (select r.run_group_id, coalesce(string_agg(distinct kind || '=' || n, ',' order by kind || '=' || n), '') as violations from runs r left join group_violations v on v.run_group_id = r.run_group_id group by r.run_group_id) v on v.run_group_id = g.run_group_id""")
def V02_group_detail(spark, sf_dir):
    see = lambda name: view(spark, sf_dir, name)
    found = nested.run_detail(see("runs"), see("scenarios"), see("published"), see("graded_fills"), see(f"select {_line} from metrics"), see("group_violations"))
    fills = lambda s: F.coalesce(F.concat(s["valid_fills"].cast("string"), F.lit("/"), s["total_fills"].cast("string")), F.lit("ungraded"))
    line = lambda s: F.array_join(F.transform(s["timeline"], lambda p: F.concat(p["wave"].cast("string"), F.lit("="), p["tps_20s"].cast("string"), F.lit("/"), p["p99"].cast("string"))), ",")
    sessions = F.transform("sessions", lambda s: F.concat(F.concat_ws(":", s["scenario_id"], s["session_id"], s["status"], fills(s)), F.lit("["), line(s), F.lit("]")))
    counts = F.transform("violations", lambda v: F.concat_ws("=", v["kind"], v["n"].cast("string")))
    return found.select("run_group_id", F.col("score.peak_sustained_tps").alias("score_peak"), F.array_join(counts, ",").alias("violations"), F.array_join(sessions, ";").alias("sessions"))


_start = B + 3 * 3600 * SECOND_NS
_id = f"{_start // 1_000_000:012x}"
_uuid = f"{_id[:8]}-{_id[8:]}-7000-8000-000000000003"


@query(f"select order_id, t0 from timed_orders where session_no = 3 and t0 >= {_start - 60 * SECOND_NS} and t0 <= {_start + 7200 * SECOND_NS} and {_md5} % 8 in (6, 7, 0)")
def S07_scan_by_layout(spark, sf_dir):
    ms = F.lower(F.lpad(F.hex(F.expr(f"({B} + session_no * {3600 * SECOND_NS}) div 1000000")), 12, "0"))
    ids = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7000-8000-"), F.lpad(F.col("session_no").cast("string"), 12, "0"))
    path = folder(spark)
    io.write_events(view(spark, sf_dir, "timed_orders").select(ids.alias("session_id"), "order_id", "t0"), path, 8)
    return io.scan_layout(spark, path, _uuid, _start + 7200 * SECOND_NS, 8, band=2, width=3).select("order_id", "t0")


@query(_in_time)
def S25_bucketed_outcomes(spark, sf_dir):
    sent, acked = view(spark, sf_dir, "orders_sent"), view(spark, sf_dir, _late)
    buckets = max(8, io.tasks_for(acked), io.tasks_for(sent))
    return intime.outcomes(*(io.write_bucketed(rows, buckets) for rows in (sent, acked)))


@query("""
select submission_id, arg_max(status, row(seen_at, status)) filter (where not behind) as status, max(seen_at) filter (where not behind) as since, count(*) filter (where behind) as ignored
from (select q.*, coalesce(rank < max(rank) over (partition by submission_id order by seen_at, status rows between unbounded preceding and 1 preceding), false) as behind
  from (select s.*, case status when 'uploaded' then 0 when 'building' then 1 when 'scanned' then 2 when 'ready' then 3 when 'failed' then 4 end as rank from submission_events s where status <> 'paused') q) z
group by submission_id""")
def T20_submission_fold(spark, sf_dir):
    return io.fold_submissions(view(spark, sf_dir, "submission_events"), "submission_id", time="seen_at")


def found_violations(spark, sf_dir):
    return io.stored(violations.violations(view(spark, sf_dir, "orders_sent"), view(spark, sf_dir, "slow_acks"), anomaly_cap_ns=5 * SECOND_NS))


_each = ", ".join(f"count(*) filter (where class = '{c}') as {c}" for c in violations.CLASSES)


@query(f"select v.*, coalesce(p.phantoms, 0) as phantoms from (select session_id, {_each}, count(*) as violations from o_violations group by session_id) v left join (select session_id, count(*) as phantoms from (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from orders_acked a where fill_qty > 0 and exec_type in ('1', '2', 'F') and not exists (select 1 from orders_sent s where s.session_id = a.session_id and s.order_id = a.order_id)) d group by session_id) p on p.session_id = v.session_id")
def A21_book_free_classes(spark, sf_dir):
    beside = violations.phantoms(view(spark, sf_dir, "orders_sent"), view(spark, sf_dir, "orders_acked"))
    return violations.counters(found_violations(spark, sf_dir), ["session_id"]).join(beside, "session_id", "left").withColumn("phantoms", F.coalesce("phantoms", F.lit(0)))


@query("select * from (select v.*, row_number() over (partition by session_id, class order by order_id, detail) as nth from o_violations v) q where nth <= 100")
def A23_examples_by_class(spark, sf_dir):
    return violations.examples(found_violations(spark, sf_dir))


@query("select session_id, class, count(*) as n from o_violations group by all")
def A31_class_counts(spark, sf_dir):
    return violations.class_counts(found_violations(spark, sf_dir))


@query("select class, count(*) as n, (select count(*) from o_violations) as total, count(*) / (select cast(count(*) as double) from o_violations) as share from o_violations group by class")
def A41_class_summary(spark, sf_dir):
    return violations.summary(found_violations(spark, sf_dir))


@query(f"select run_group_id, {_each}, count(*) as violations from o_violations v join runs r on r.session_id = v.session_id group by run_group_id")
def J16_group_counters(spark, sf_dir):
    return violations.counters(found_violations(spark, sf_dir).join(view(spark, sf_dir, "runs").select("session_id", "run_group_id"), "session_id"), ["run_group_id"])
