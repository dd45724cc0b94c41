"""Views that give the sample tables the shape of order events, run state and operational samples.

Every view is written in the part of SQL that Spark and other engines share, so that a result can be checked.
"""

B, WAVE_NS, SECOND_NS = 1700000000000000000, 20_000_000_000, 1_000_000_000

VIEWS = {
    "orders_sent": f"""
select concat('s', cast(o_orderkey % 20 as string)) as session_id, concat('c', cast(o_orderkey % 5 as string)) as contestant_id,
       cast(o_orderkey as string) as order_id, cast(o_orderkey % 8 as int) as task_id, {B} + o_orderkey * 20000000 as t0,
       {B} + o_orderkey * 20000000 + (o_orderkey * 7919 % 1000) * 1000 as t1,
       case when o_orderkey % 9 = 4 and o_orderkey % 20 < 10 then 0 else {B} + o_orderkey * 20000000 + 5000000 + (o_orderkey * 7919 % 5000) * 1000 end as r9,
       o_orderkey % 9 = 4 and o_orderkey % 20 < 10 as timed_out, 10000 + o_orderkey % 25 - 12 as price, cast(100 as bigint) as qty,
       case when o_custkey % 2 = 0 then 'SELL' else 'BUY' end as side,
       case o_orderpriority when '5-LOW' then 'CANCEL' when '4-NOT SPECIFIED' then 'REPLACE' else 'NEW' end as payload_type,
       case when o_orderstatus = 'P' then 'MARKET' else 'LIMIT' end as ord_type,
       case when o_orderpriority in ('5-LOW', '4-NOT SPECIFIED') and o_orderkey >= 20 then cast(o_orderkey - 20 as string) else '' end as orig_order_id,
       cast({B} as bigint) as barrier_epoch_ns, case when o_custkey % 9 = 8 then null else o_custkey % 9 end as smp_id
from orders""",
    # Some answers carry an id that nobody sent, so that there are phantoms and gaps; every row is read.
    "orders_acked": """
select concat('s', cast(o.o_orderkey % 20 as string)) as session_id, case when o.o_orderkey % 397 = 3 then 'c9' else concat('c', cast(o.o_orderkey % 5 as string)) end as contestant_id,
       cast(case when o.o_orderkey % 211 = 7 then o.o_orderkey + 1000000000000 else o.o_orderkey end as string) as order_id, o.o_custkey % 4 as src_ip, 50000 + o.o_custkey % 16 as src_port,
       (o.o_orderkey * 640) % 4294967296 as tcp_seq,
       1700000000000000000 + o.o_orderkey * 20000000 + 1000000 + (o.o_orderkey * 31 % 400) * 1000 as t3,
       1700000000000000000 + o.o_orderkey * 20000000 + 1000000 + (o.o_orderkey * 31 % 400) * 1000 + l.l_linenumber * 20000 + (l.l_partkey % 97) * 1000 + case when o.o_orderkey % 37 = 5 and o.o_orderkey % 20 < 10 then 1500000000 else 0 end as t7,
       case l.l_returnflag when 'R' then case when o.o_orderkey % 20 < 10 then '8' else '0' end when 'A' then '0' else 'F' end as exec_type,
       case when l.l_returnflag = 'N' then cast(l.l_quantity as bigint) else cast(0 as bigint) end as fill_qty,
       case when l.l_returnflag = 'N' then (10000 + o.o_orderkey % 25 - 12) * 1000000000 else cast(0 as bigint) end as fill_price,
       case when l.l_linestatus = 'F' then 2 else 1 end as liquidity_ind
from lineitem l join orders o on o.o_orderkey = l.l_orderkey""",
    "tasks": """
select case p_partkey % 4 when 0 then 'constant' when 1 then 'spike' when 2 then 'ramp' else 'correctness' end as scenario, p_partkey as task_id,
       case p_partkey % 3 when 0 then 'hft' when 1 then 'retail' else 'institutional' end as profile,
       case when p_partkey % 4 = 3 then cast(0 as bigint) when p_partkey % 3 = 0 then cast(1000 as bigint) when p_partkey % 3 = 1 then cast(5 as bigint) else cast(300 as bigint) end as target_rps,
       (p_size % 9) * cast(20000000000 as bigint) as start_offset_ns, cast(180000000000 as bigint) - (p_size % 9) * cast(20000000000 as bigint) as duration_ns
from part""",
    "runs": """
select concat('s', cast(n as string)) as session_id, concat('sub', cast(n % 5 as string)) as submission_id, concat('c', cast(n % 5 as string)) as contestant_id,
       concat('g', cast(n % 5 as string)) as run_group_id, case when n < 5 then 'constant' when n < 10 then 'spike' when n < 15 then 'ramp' else 'correctness' end as scenario_id,
       case when n = 19 then 'running' else 'completed' end as status
from (select n_nationkey as n from nation where n_nationkey < 20) q""",
    "scenarios": """
select scenario as scenario_id, cast(max(start_offset_ns + duration_ns) / 1000000000 as bigint) as duration_s, case scenario when 'constant' then 1 when 'spike' then 2 when 'ramp' then 3 else 4 end as sort_order
from tasks group by scenario""",
    "published": "select * from scores where run_group_id not in ('g2', 'g4')",
    "scores": """
select concat('g', cast(c_custkey as string)) as run_group_id, concat('c', cast(c_nationkey as string)) as contestant_id, c_name as team_name,
       (c_custkey % 10) * cast(10000 as bigint) as peak_sustained_tps, c_custkey * 7919 % 1000 * 1000 as p99_at_peak_ns,
       c_custkey % 4 * cast(20000000000 as bigint) as spike_recovery_ns, cast(900 + c_custkey % 101 as double) / 1000 as total_correctness, c_custkey % 13 = 0 as disqualified
from customer""",
    "status_events": """
select concat('k', cast(user_id as string)) as entity_id, event_id, ts,
       case event_type when 'click' then 'building' when 'view' then 'scanned' when 'signup' then 'ready' when 'purchase' then 'uploaded' else 'failed' end as submission_status,
       case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'click' then 'queued' when 'view' then 'deploying' else 'running' end as run_status
from events""",
    "metric_samples": """
select event_type as name, user_id % 5 as label, ts, event_id,
       cast(sum(cast(round(value * 100) as bigint)) over (partition by event_type, user_id % 5, (event_id - event_id % 997) order by ts, event_id rows between unbounded preceding and current row) as bigint) as counter_value
from events""",
    "logs": """
select ts, concat('svc', cast(user_id % 5 as string)) as service_name, case when event_type = 'error' then 'ERROR' when event_type = 'view' then 'WARN' else 'INFO' end as level,
       case when event_type = 'signup' then '' else concat('/', event_type) end as http_path
from events""",
    # Some segments begin 30 bytes before the last one's end, some 500 after it.
    "capture_segments": """
select l_suppkey % 8 as flow, l_linenumber % 2 as direction, l_orderkey * 100 + l_linenumber as arrival,
       cast(sum(cast(l_quantity as bigint) * 10 + case when l_partkey % 77 = 0 then 500 else 0 end) over (partition by l_suppkey % 8, l_linenumber % 2 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice rows between unbounded preceding and current row)
         - cast(l_quantity as bigint) * 10 - case when l_partkey % 50 = 0 then 30 else 0 end as bigint) as seq_start,
       cast(l_quantity as bigint) * 10 as seq_len
from lineitem""",
    # Orders with their wave; answers of orders that the client did not time out; each order's first answer.
    "sent_waves": f"select s.*, cast((greatest(t0 - origin, 0) - greatest(t0 - origin, 0) % {WAVE_NS}) / {WAVE_NS} as bigint) as wave from (select o.*, case when o.barrier_epoch_ns > 0 then o.barrier_epoch_ns else f.first_ns end as origin from orders_sent o left join (select session_id, min(t0) as first_ns from orders_sent where barrier_epoch_ns <= 0 group by session_id) f on f.session_id = o.session_id) s",
    "live_acks": f"""
select a.*, cast((greatest(t3 - {B}, 0) - greatest(t3 - {B}, 0) % {WAVE_NS}) / {WAVE_NS} as bigint) as wave, fill_qty > 0 and exec_type in ('1', '2', 'F') as is_fill
from orders_acked a where not exists (select 1 from orders_sent s where s.session_id = a.session_id and s.order_id = a.order_id and s.timed_out)""",
    "first_acks": "select * from (select a.*, row_number() over (partition by session_id, order_id order by t7, exec_type, fill_qty, fill_price, liquidity_ind) as nth from live_acks a) q where nth = 1",
    # One pass over orders and one over answers; each row gives up to two samples.
    "sent_samples": "select session_id, wave, stack(2, 'response', case when not timed_out and r9 > t0 then greatest(r9 - t0, 1) end, 'slip', case when t1 >= t0 then greatest(t1 - t0, 1) end) as (metric, v) from sent_waves",
    "ack_samples": """
select session_id, wave, stack(2, 'service', case when nth = 1 then greatest(t7 - t3, 1) end, 'match', case when liquidity_ind = 2 then greatest(t7 - t3, 1) end) as (metric, v)
from (select a.*, row_number() over (partition by session_id, order_id order by t7, exec_type, fill_qty, fill_price, liquidity_ind) as nth from live_acks a) q""",
    "samples": "select session_id, wave, metric, v from ack_samples where v is not null union all select session_id, wave, metric, v from sent_samples where v is not null",
    "histograms": """
select session_id, wave, metric, bucket_hi, count(*) as n from (
  select session_id, wave, metric, ((v >> b) << b) + (cast(1 as bigint) << b) - 1 as bucket_hi from (
    select s.*, cast(greatest(length(bin(v | 2047)) - 11, 0) as int) as b from samples s where v < 68719476736) p) q
group by session_id, wave, metric, bucket_hi""",
    "cumulative": """
select h.*, cast(sum(n) over (partition by session_id, wave, metric order by bucket_hi rows between unbounded preceding and current row) as bigint) as cum,
       cast(sum(n) over (partition by session_id, wave, metric) as bigint) as total from histograms h""",
    "wave_quantiles": f"""
select session_id, wave, {", ".join(f"coalesce(min(bucket_hi) filter (where metric = '{m}' and cum >= greatest(1, ceil({q} * total))), 0) as {n}" for m, q, n in (("service", 0.5, "p50"), ("service", 0.9, "p90"), ("service", 0.99, "p99"), ("service", 0.999, "p999"), ("response", 0.5, "rt_p50"), ("response", 0.9, "rt_p90"), ("response", 0.99, "rt_p99")))}
from cumulative where metric in ('service', 'response') group by session_id, wave having count(*) filter (where metric = 'service') > 0""",
    "window_counters": """
select coalesce(s.session_id, a.session_id) as session_id, coalesce(s.wave, a.wave) as wave, coalesce(offered, 0) as offered, coalesce(timed_out, 0) as timed_out,
       coalesce(responded, 0) as responded, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected, coalesce(fills, 0) as fills
from (select session_id, wave, count(*) as offered, count(*) filter (where timed_out) as timed_out from sent_waves group by session_id, wave) s
full outer join (
  select l.session_id, l.wave, count(*) filter (where nth = 1) as responded, count(*) filter (where nth = 1 and exec_type <> '8') as accepted, count(*) filter (where nth = 1 and exec_type = '8') as rejected, count(*) filter (where is_fill) as fills
  from (select l.*, row_number() over (partition by session_id, order_id order by t7, exec_type, fill_qty, fill_price, liquidity_ind) as nth from live_acks l) l
  group by l.session_id, l.wave) a on a.session_id = s.session_id and a.wave = s.wave""",
    "metrics": """
select c.session_id, c.wave, p50, p99, responded as tps_20s, offered, timed_out + rejected as errors, case when offered > 0 then cast(timed_out + rejected as double) / offered else 0.0 end as error_rate
from window_counters c join (
  select session_id, wave, min(bucket_hi) filter (where cum >= greatest(1, ceil(0.50 * total))) as p50, min(bucket_hi) filter (where cum >= greatest(1, ceil(0.99 * total))) as p99
  from cumulative where metric = 'service' group by session_id, wave) q on q.session_id = c.session_id and q.wave = c.wave""",
    "outcomes": """
select s.session_id, s.order_id, s.payload_type, s.timed_out, s.qty, coalesce(a.n_acks, 0) as n_acks, coalesce(a.filled, 0) as filled, a.first_t3, a.first_t7,
       case when coalesce(a.n_acks, 0) > 0 then 'matched' when s.timed_out then 'lost' else 'gap' end as outcome
from orders_sent s left join (
  select session_id, order_id, count(*) as n_acks, cast(sum(fill_qty) as bigint) as filled, min(t3) as first_t3, min(t7) as first_t7
  from (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from orders_acked) d group by session_id, order_id) a
on a.session_id = s.session_id and a.order_id = s.order_id""",
    # Each task is laid on the grid of the waves that it overlaps.
    "wave_load": f"""
select scenario, wave, cast(sum(target_rps * (least(start_offset_ns + duration_ns, (wave + 1) * {WAVE_NS}) - greatest(start_offset_ns, wave * {WAVE_NS})) / 1000000000) as bigint) as offered_orders
from (select t.*, explode(sequence(start_offset_ns div {WAVE_NS}, (start_offset_ns + duration_ns - 1) div {WAVE_NS})) as wave from tasks t where duration_ns > 0) q
group by scenario, wave""",
    # Places without one task for all rows: how many come before each (flag, peak, stretch of p99), of which there are as many as the schedules' rates
    # and the histograms' stretches allow, and the place inside it.
    "board_steps": """
select disqualified, peak_sustained_tps, p99_from, cast(sum(n) over (order by disqualified, peak_sustained_tps desc, p99_from rows between unbounded preceding and current row) - n as bigint) as ahead
from (select disqualified, peak_sustained_tps, p99_at_peak_ns - p99_at_peak_ns % 100000 as p99_from, count(*) as n from scores group by disqualified, peak_sustained_tps, p99_at_peak_ns - p99_at_peak_ns % 100000) q""",
    "board": """
select s.run_group_id, s.contestant_id, s.team_name, s.peak_sustained_tps, s.p99_at_peak_ns, s.spike_recovery_ns, s.total_correctness, s.disqualified,
       b.ahead + row_number() over (partition by s.disqualified, s.peak_sustained_tps, s.p99_at_peak_ns - s.p99_at_peak_ns % 100000 order by s.p99_at_peak_ns, s.spike_recovery_ns, s.total_correctness desc, s.run_group_id) as place
from scores s join board_steps b on b.disqualified = s.disqualified and b.peak_sustained_tps = s.peak_sustained_tps and b.p99_from = s.p99_at_peak_ns - s.p99_at_peak_ns % 100000""",
    "p99_steps": "select p99_at_peak_ns, cast(sum(n) over (order by p99_at_peak_ns rows between unbounded preceding and current row) - n as bigint) as ahead from (select p99_at_peak_ns, count(*) as n from scores group by p99_at_peak_ns) q",
    "counter_steps": """
select name, label, ts, event_id, case when prev is null then 0 when counter_value < prev then counter_value else counter_value - prev end as step
from (select m.*, lag(counter_value) over (partition by name, label order by ts, event_id) as prev from metric_samples m) q""",
}
