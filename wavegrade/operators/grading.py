"""Grading, scoring, serving and capture queries. ORACLES holds another statement where engines differ or a plainer form says the same."""

from wavegrade.sources.views import B, SECOND_NS, WAVE_NS



def _listed(text: str, order: str, between: str) -> str:
    """The texts of a group in order, as one."""
    return f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 't', {text}))), x -> x.t), '{between}')"


def _field(tag: int) -> str:
    """The value of a FIX field of m, which has a separator in front; null if it isn't there. Only the fields that a query reads are looked for."""
    mark = f"concat(chr(1), '{tag}=')"
    return f"case when instr(m, {mark}) > 0 then substring_index(substring(m, instr(m, {mark}) + {len(str(tag)) + 2}), chr(1), 1) end"


VIEWS = {
    # One row per answered order, in replay order: effective arrival, flow, sequence.
    "replayed": """
select q.*, row_number() over (partition by session_id order by eff_t3, src_ip, src_port, tcp_seq, cast(order_id as bigint)) as nth
from (select a.*, max(t3) over (partition by session_id, src_ip, src_port order by tcp_seq, cast(order_id as bigint) rows between unbounded preceding and current row) as eff_t3
  from (select session_id, order_id, src_ip, src_port, tcp_seq, min(t3) as t3, min(t7) as min_t7 from orders_acked group by session_id, order_id, src_ip, src_port, tcp_seq) a) q""",
    "fix_messages": """
select session_id, order_id, 'out' as direction, t7 as at_ns, concat('35=8', chr(1), '11=', order_id, chr(1), '150=', exec_type, chr(1), '39=', exec_type, chr(1), '32=', cast(fill_qty as string), chr(1), '31=', cast(fill_price as string), chr(1), '851=', cast(liquidity_ind as string)) as msg
from orders_acked union all
select session_id, order_id, 'in', t1, concat('35=', case payload_type when 'CANCEL' then 'F' when 'REPLACE' then 'G' else 'D' end, chr(1), '11=', order_id, case when orig_order_id <> '' then concat(chr(1), '41=', orig_order_id) else '' end) from orders_sent""",
    "messages": f"""
select session_id, direction, at_ns, {_field(35)} as msg_type, coalesce({_field(11)}, '') as cl_ord_id, coalesce({_field(41)}, '') as orig_id,
       coalesce({_field(150)}, {_field(39)}, '') as exec_type, coalesce(cast({_field(32)} as bigint), 0) as fill_qty
from (select session_id, direction, at_ns, concat(chr(1), msg) as m from fix_messages) f""",
    "classed": "select m.*, case when msg_type in ('D', 'F', 'G') and direction = 'in' then 'request' when msg_type = '8' and direction = 'out' then 'response' else 'other' end as class from messages m",
    "shard_seconds": f"""
select session_id, cast(cast(order_id as bigint) % 3 as bigint) as shard, wave, t7 - t7 % {SECOND_NS} as second_ns, ((v >> b) << b) + (cast(1 as bigint) << b) - 1 as bucket_hi, count(*) as n
from (select a.*, greatest(t7 - t3, 1) as v, cast(greatest(length(bin(greatest(t7 - t3, 1) | 2047)) - 11, 0) as int) as b from first_acks a) q
group by session_id, cast(order_id as bigint) % 3, wave, t7 - t7 % {SECOND_NS}, ((v >> b) << b) + (cast(1 as bigint) << b) - 1""",
    # Per session and second: the p99 of the second's first answers, their number, and the orders offered and failed in it.
    "second_rows": f"""
select s.session_id, s.second_ns, coalesce(q.p99, 0) as p99, coalesce(q.n, 0) as n, s.offered, s.errors
from (select session_id, t0 - t0 % {SECOND_NS} as second_ns, count(*) as offered, count(*) filter (where timed_out) as errors from orders_sent group by session_id, t0 - t0 % {SECOND_NS}) s
left join (select session_id, second_ns, min(bucket_hi) filter (where cum >= ceil(0.99 * total)) as p99, max(total) as n
  from (select z.*, cast(sum(n) over (partition by session_id, second_ns order by bucket_hi rows between unbounded preceding and current row) as bigint) as cum, cast(sum(n) over (partition by session_id, second_ns) as bigint) as total
    from (select session_id, second_ns, bucket_hi, cast(sum(n) as bigint) as n from shard_seconds group by session_id, second_ns, bucket_hi) z) y group by session_id, second_ns) q
on q.session_id = s.session_id and q.second_ns = s.second_ns""",
    "session_state": "select r.run_group_id, r.session_id, r.scenario_id, count(*) as sent, count(*) filter (where outcome = 'matched') as matched, cast(sum(filled) as bigint) as fills, cast(sum(least(filled, qty)) as bigint) as valid_fills from runs r join outcomes o on o.session_id = r.session_id group by r.run_group_id, r.session_id, r.scenario_id",
    # The metrics that runs are scored on: one ramp session lacks a wave, one is slow in a wave, one has errors in a wave.
    "scored_metrics": """
select session_id, wave, tps_20s, case when session_id = 's12' and wave = 3 then p99 + 5000000 else p99 end as p99, case when session_id = 's13' and wave = 5 then cast(0.02 as double) else error_rate end as error_rate
from metrics where not (session_id = 's11' and wave = 4)""",
    # Sessions as graded: one correctness session and one other lost fills, and one group has no ramp.
    "graded_sessions": "select run_group_id, session_id, scenario_id, sent, matched - case when session_id = 's7' then cast(floor(sent * 0.15) as bigint) else 0 end as matched, fills, valid_fills - case when session_id in ('s15', 's6') then cast(floor(fills * 0.2) as bigint) else 0 end as valid_fills from session_state where not (run_group_id = 'g3' and scenario_id = 'ramp')",
    "climb": f"""
select l.run_group_id, l.session_id, l.wave, l.offered_orders, l.offered_orders / {WAVE_NS // SECOND_NS} as offered_tps, m.p99, m.error_rate,
       case when m.m_session is null then 'missing_metrics' when m.error_rate > 0.01 then 'error_rate' when m.p99 > 1000000 then 'p99_latency' end as reason
from (select r.run_group_id, r.session_id, w.wave, w.offered_orders from graded_sessions r join wave_load w on w.scenario = r.scenario_id where r.scenario_id = 'ramp' and w.wave >= 1) l left join (select session_id as m_session, wave as m_wave, p99, error_rate from scored_metrics) m on m.m_session = l.session_id and m.m_wave = l.wave""",
    "climbed": "select c.*, min(case when reason is not null then wave end) over (partition by session_id) as first_fail from climb c",
    # Peak and reason of each ramp session; the waves up to the first that fails.
    "peaks": "select run_group_id, session_id, first_fail, max(case when wave = first_fail then reason end) as fail_reason, max(case when reason is null then wave end) as last_pass, max_by(offered_tps, wave) filter (where reason is null) as peak_tps, max_by(p99, wave) filter (where reason is null) as p99_at_peak from climbed where wave <= coalesce(first_fail, wave) group by run_group_id, session_id, first_fail",
    "wave_texts": f"select run_group_id, session_id, {_listed("concat(cast(wave as string), ':', cast(offered_orders as string), ':', coalesce(reason, 'pass'))", 'wave', ' ')} as waves from climbed where wave <= coalesce(first_fail, wave) group by run_group_id, session_id",
    "coverage_gaps": f"select g.run_group_id, min(c.sort_order) as first_order, min_by(concat(g.session_id, ' covers ', cast(g.matched as string), ' of ', cast(g.sent as string)), c.sort_order) as reason from graded_sessions g join scenarios c on c.scenario_id = g.scenario_id where g.sent > 0 and cast(g.matched as double) / g.sent < 0.90 group by g.run_group_id",
    "disqualified": "select run_group_id, correctness, case when correctness < 0.95 then 'correctness_below_threshold' when worst < 0.95 then 'session_correctness_below_threshold' end as reason, ramps from (select run_group_id, least(case when g_total > 0 then cast(g_valid as double) / g_total else 0.0 end, 1.0) as correctness, worst, ramps from (select run_group_id, coalesce(cast(sum(valid_fills) filter (where scenario_id = 'correctness') as bigint), 0) as g_valid, coalesce(cast(sum(fills) filter (where scenario_id = 'correctness') as bigint), 0) as g_total, min(case when fills > 0 then cast(valid_fills as double) / fills end) as worst, count(*) filter (where scenario_id = 'ramp') as ramps from graded_sessions group by run_group_id) q) z",
    "session_texts": f"select run_group_id, {_listed("concat(g_session, '[', w_waves, ']')", 'g_session', ' ')} as sessions from (select g.run_group_id, g.session_id as g_session, coalesce(w.waves, '') as w_waves from graded_sessions g left join wave_texts w on w.session_id = g.session_id) q group by run_group_id",
}

QUERIES = {
    "P08_price_scale": "select order_id, cast(split_part(txt, '.', 1) as bigint) * 1000000000 + cast(rpad(substr(split_part(txt, '.', 2), 1, 9), 9, '0') as bigint) as scaled from (select order_id, concat(cast(price as string), '.', cast(t1 - t0 as string), '1234') as txt from orders_sent) q",
    "P10_referenced_id": "select s.session_id, s.order_id, coalesce(nullif(s.orig_order_id, ''), a.ref) as ref_id from orders_sent s left join (select session_id, order_id, min_by(x, t7) filter (where x <> '') as ref from (select a.*, case when liquidity_ind = 2 then concat('r', order_id) else '' end as x from orders_acked a) q group by session_id, order_id) a on a.session_id = s.session_id and a.order_id = s.order_id",
    "P11_fix_fields": "select * from messages",
    "P12_json_fields": "select order_id, cast(get_json_object(js, '$.fill_qty') as bigint) as fill_qty, get_json_object(js, '$.exec_type') as exec_type from (select order_id, concat(chr(123), '\"fill_qty\":', cast(fill_qty as string), ',\"exec_type\":\"', exec_type, '\"', chr(125)) as js from orders_acked) q",
    "P13_message_class": "select class, direction, count(*) as n from classed group by class, direction",
    "P14_order_id_parts": "select id, regexp_extract(id, '^(.*)_([0-9]+)_([0-9]+)_(.)$', 1) as session_id, cast(regexp_extract(id, '^(.*)_([0-9]+)_([0-9]+)_(.)$', 2) as bigint) as task_id, cast(regexp_extract(id, '^(.*)_([0-9]+)_([0-9]+)_(.)$', 3) as bigint) as seq, regexp_extract(id, '^(.*)_([0-9]+)_([0-9]+)_(.)$', 4) as kind from (select concat(session_id, '_', cast(task_id as string), '_', order_id, '_', substr(payload_type, 1, 1)) as id from orders_sent) q",
    "P16_shard": "select order_id, pmod(cast(conv(substr(md5(order_id), 1, 15), 16, 10) as bigint), 24) as shard, pmod(cast(task_id * 4 + pmod(cast(conv(substr(md5(order_id), 1, 15), 16, 10) as bigint), 4) as bigint), 24) as banded from orders_sent",
    "P17_uuid_time": "select order_id, cast(conv(substr(replace(id, '-', ''), 1, 12), 16, 10) as bigint) as ms from (select order_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-7000-8000-000000000000') as id from (select order_id, lower(lpad(hex(t0 div 1000000), 12, '0')) as h from orders_sent) q) u where substr(id, 15, 1) = '7'",
    "P18_protocol_list": "select team_name, array_join(transform(split(list, ','), x -> upper(trim(x))), ',') as protocols, size(array_distinct(transform(split(list, ','), x -> upper(trim(x))))) < size(split(list, ',')) as has_repeats from (select team_name, concat(' fix, ', case when disqualified then 'FIX' else 'rest' end, ' ,', contestant_id) as list from scores) q",
    "P25_overlap": f"select task_id, greatest(least(start_offset_ns + duration_ns, {2 * WAVE_NS}) - greatest(start_offset_ns, {WAVE_NS}), 0) as overlap_ns from tasks",
    "P32_warmup_trim": f"select session_id, second_ns, n from (select q.*, min(second_ns) over (partition by session_id) as first_ns from (select session_id, t7 - t7 % {SECOND_NS} as second_ns, count(*) as n from orders_acked group by session_id, t7 - t7 % {SECOND_NS}) q) z where second_ns >= first_ns + {2 * SECOND_NS}",
    "P34_id_admission": "select session_id, count(*) filter (where cl_ord_id <> '') as admitted, count(*) filter (where length(cl_ord_id) > 4) as long_ids from messages group by session_id",
    "P36_stale_filter": f"select entity_id, event_id from (select entity_id, event_id, case when event_id % 7 = 0 then 0 else event_id end as published, max(event_id) over (partition by entity_id) as newest from status_events) q where published = 0 or newest - published <= 500",
    "P38_null_defaults": "select r.session_id, coalesce(m.waves, 0) as waves, coalesce(m.top, 0) as top_p99 from runs r left join (select session_id, count(*) as waves, max(p99) as top from metrics where wave > 0 group by session_id) m on m.session_id = r.session_id",
    "J05_request_response": "select r.session_id, r.cl_ord_id, r.at_ns as t7, q.first_ns as t3 from (select session_id, cl_ord_id, at_ns from classed where class = 'response') r join (select session_id, cl_ord_id, min(at_ns) as first_ns from classed where class = 'request' group by session_id, cl_ord_id) q on q.session_id = r.session_id and q.cl_ord_id = r.cl_ord_id where r.at_ns >= q.first_ns",
    "J16_violations_per_group": "select r.run_group_id, count(*) filter (where o.filled > o.qty) as overfill, count(*) filter (where o.outcome = 'lost') as lost from runs r join outcomes o on o.session_id = r.session_id group by r.run_group_id",
    "J19_live_feed": "select r.session_id, r.contestant_id, m.wave, m.p99 from runs r join (select session_id, max(wave) as wave, max_by(p99, wave) as p99 from metrics group by session_id) m on m.session_id = r.session_id where r.status not in ('completed', 'failed')",
    "J21_merged_timeline": "select session_id, at_ns, kind, order_id from (select session_id, t0 as at_ns, 'sent' as kind, order_id from orders_sent union all select session_id, t3, 'acked', order_id from orders_acked) u order by session_id, at_ns, kind, order_id",
    "J23_runs_listing": "select r.session_id, c.scenario_id, c.sort_order from runs r left join scenarios c on c.scenario_id = r.scenario_id order by c.sort_order, r.session_id",
    "J24_session_scenarios": "select m.session_id, max(r.scenario_id) as scenario_id, count(*) as waves from metrics m join runs r on r.session_id = m.session_id group by m.session_id",
    "A05_second_slices": "select session_id, wave, second_ns, bucket_hi, cast(sum(n) as bigint) as n from shard_seconds group by session_id, wave, second_ns, bucket_hi",
    "A08_rollup": "select session_id, wave, second_ns, min(bucket_hi) filter (where cum >= ceil(0.99 * total)) as p99, max(total) as n from (select z.*, cast(sum(n) over (partition by session_id, wave, second_ns order by bucket_hi rows between unbounded preceding and current row) as bigint) as cum, cast(sum(n) over (partition by session_id, wave, second_ns) as bigint) as total from (select session_id, wave, second_ns, bucket_hi, sum(n) as n from shard_seconds group by session_id, wave, second_ns, bucket_hi) z) q group by session_id, wave, second_ns",
    "A10_retention": f"select session_id, second_ns from (select distinct session_id, second_ns from shard_seconds) d where second_ns >= (select max(second_ns) from shard_seconds) - {6 * 3600 * SECOND_NS}",
    "A19_disqualification": "select run_group_id, correctness, reason, case when ramps = 0 and reason is null then 'no ramp session' end as error from disqualified",
    "A20_score": "select d.run_group_id, d.correctness, d.reason is not null as disqualified, coalesce(d.reason, case when d.ramps = 0 then 'no ramp session' end) as reason, v.reason as incomplete, p.first_fail, p.fail_reason, case when d.reason is null then p.peak_tps end as peak_tps, case when d.reason is null then p.p99_at_peak end as p99_at_peak, t.sessions from disqualified d left join peaks p on p.run_group_id = d.run_group_id left join coverage_gaps v on v.run_group_id = d.run_group_id left join session_texts t on t.run_group_id = d.run_group_id",
    "A16_peak_climb": "select p.session_id, p.first_fail, p.fail_reason, p.last_pass, p.peak_tps, p.p99_at_peak, w.waves from peaks p join wave_texts w on w.session_id = p.session_id",
    "A17_max_rate": "select m.session_id, cast(round(max(cast(m.tps_20s as double) / 20)) as bigint) as peak from metrics m join runs r on r.session_id = m.session_id join (select scenario from tasks group by scenario having max(target_rps) = 0) t on t.scenario = r.scenario_id group by m.session_id",
    "A27_gap_spread": f"select s.session_id, max(s.t0) - min(s.t0) as spread_ns, count(*) filter (where s.t0 >= z.last_ns - {SECOND_NS}) as in_final_second from orders_sent s join outcomes o on o.session_id = s.session_id and o.order_id = s.order_id join (select session_id, max(t0) as last_ns from orders_sent group by session_id) z on z.session_id = s.session_id where o.outcome = 'gap' group by s.session_id",
    "A31_unpivot": "select session_id, class, n from (select session_id, 'overfill' as class, count(*) as n from outcomes where filled > qty group by session_id union all select session_id, case when payload_type = 'CANCEL' then 'lost_cancel' else 'lost_order' end, count(*) from outcomes where outcome = 'lost' group by session_id, case when payload_type = 'CANCEL' then 'lost_cancel' else 'lost_order' end) u where n > 0",
    "A35_percentile_curve": "select c.session_id, c.metric, p.pct, case when p.pct < 100 then round(cast(100 as double) / (100 - p.pct), 6) end as nines, max(c.total) as total, min(c.bucket_hi) as value from (select h.*, cast(sum(n) over (partition by session_id, metric order by bucket_hi rows between unbounded preceding and current row) as bigint) as cum, cast(sum(n) over (partition by session_id, metric) as bigint) as total from (select session_id, metric, bucket_hi, cast(sum(n) as bigint) as n from histograms group by session_id, metric, bucket_hi) h) c join (select 0.0 as pct union all select 25.0 union all select 50.0 union all select 75.0 union all select 90.0 union all select 95.0 union all select 99.0 union all select 99.9 union all select 99.99) p on c.cum >= greatest(1, ceil(p.pct / 100 * c.total)) group by c.session_id, c.metric, p.pct",
    "A37_scenario_series": "select r.scenario_id, h.metric, h.bucket_hi, cast(sum(h.n) as bigint) as n from histograms h join runs r on r.session_id = h.session_id where h.metric in ('service', 'response', 'match') group by r.scenario_id, h.metric, h.bucket_hi",
    "A41_violation_summary": "select class, n from (select case when outcome = 'lost' then 'lost' else 'overfill' end as class, count(*) as n from outcomes where outcome = 'lost' or filled > qty group by case when outcome = 'lost' then 'lost' else 'overfill' end) q order by n desc, class",
    "A43_run_gate": "select r.session_id, coalesce(m.n, 0) > 0 and coalesce(o.n, 0) > 0 as passes from runs r left join (select session_id, count(*) as n from metrics group by session_id) m on m.session_id = r.session_id left join (select session_id, count(*) as n from outcomes group by session_id) o on o.session_id = r.session_id",
    "W02_rank_of": "select g.run_group_id, count(*) as place from (select * from scores where run_group_id = 'g7') g join scores s on named_struct('a', s.disqualified, 'b', -s.peak_sustained_tps, 'c', s.p99_at_peak_ns, 'd', s.spike_recovery_ns, 'e', -s.total_correctness, 'f', s.run_group_id) <= named_struct('a', g.disqualified, 'b', -g.peak_sustained_tps, 'c', g.p99_at_peak_ns, 'd', g.spike_recovery_ns, 'e', -g.total_correctness, 'f', g.run_group_id) group by g.run_group_id",
    "W09_carry_forward": "select session_id, shard, second_ns, max(cum) over (partition by session_id, shard order by second_ns rows between unbounded preceding and current row) as carried from (select g.session_id, g.shard, g.second_ns, q.cum from (select s.session_id, s.shard, t.second_ns from (select distinct session_id, shard from shard_seconds) s join (select distinct session_id, second_ns from shard_seconds) t on t.session_id = s.session_id) g left join (select session_id, shard, second_ns, cast(sum(n) over (partition by session_id, shard order by second_ns rows between unbounded preceding and current row) as bigint) as cum from (select session_id, shard, second_ns, sum(n) as n from shard_seconds group by session_id, shard, second_ns) a) q on q.session_id = g.session_id and q.shard = g.shard and q.second_ns = g.second_ns) z",
    "W10_differences": "select session_id, wave, responded - coalesce(lag(responded) over (partition by session_id order by wave), 0) as step from window_counters",
    "W11_newest_of_wave": "select session_id, wave, second_ns, second_ns = max(second_ns) over (partition by session_id, wave) as newest from (select distinct session_id, wave, second_ns from shard_seconds) q",
    "W13_rank_change": "select run_group_id, publication, place, coalesce(lag(place) over (partition by run_group_id order by publication) - place, 0) as rank_delta from (select s.run_group_id, 1 as publication, p.ahead + row_number() over (partition by s.p99_at_peak_ns order by s.run_group_id) as place from scores s join p99_steps p on p.p99_at_peak_ns = s.p99_at_peak_ns union all select run_group_id, 2, place from board) q",
    "L03_result_sort": "select run_group_id, place from board order by place",
    "L04_timeline": "select session_id, second_ns, n from (select session_id, second_ns, cast(sum(n) as bigint) as n from shard_seconds group by session_id, second_ns) q order by second_ns, session_id limit 20000",
    "L05_group_search": "select run_group_id, team_name from scores where lower(team_name) like '%1%' order by run_group_id desc limit 100",
    "L06_active_nested": "select run_group_id, count(*) as sessions, min(session_id) as first_session from runs where run_group_id in (select run_group_id from runs where status not in ('completed', 'failed')) group by run_group_id order by run_group_id desc limit 500",
    "U05_content_dedupe": "select digest, min(event_id) as first_event, count(*) as n from (select event_id, md5(concat(entity_id, run_status)) as digest from status_events) q group by digest",
    "C03_out_of_order": "select flow, direction, count(*) filter (where seq_start > prev_end) as ahead from (select s.*, max(seq_start + seq_len) over (partition by flow, direction order by arrival, seq_start, seq_len rows between unbounded preceding and 1 preceding) as prev_end from capture_segments s) q group by flow, direction",
    "C04_truncated": "select flow, direction, count(*) filter (where seq_len > 400) as truncated from capture_segments group by flow, direction",
    "C05_message_rows": "select session_id, class, msg_type, exec_type, count(*) as n, cast(sum(fill_qty) as bigint) as fill_qty from classed group by session_id, class, msg_type, exec_type",
    "C06_matched": "select session_id, cl_ord_id, count(*) filter (where class = 'request') - 1 as retransmissions, min(at_ns) filter (where class = 'response') - min(at_ns) filter (where class = 'request') as service_ns from classed group by session_id, cl_ord_id having count(*) filter (where class = 'request') > 0 and count(*) filter (where class = 'response') > 0",
    "C07_unmatched": "select r.session_id, r.cl_ord_id, r.at_ns from classed r where r.class = 'response' and not exists (select 1 from classed q where q.class = 'request' and q.session_id = r.session_id and q.cl_ord_id = r.cl_ord_id)",
    "C08_funnel": "select stage, count(*) as n from (select class as stage from classed union all select outcome from outcomes) u group by stage",
    "V01_leaderboard": "select run_group_id, team_name, place from board where run_group_id in (select run_group_id from scores where contestant_id <> 'c0') order by place limit 101",
    "V02_run_detail": "select r.run_group_id, r.session_id, r.scenario_id, m.waves, m.peak, o.lost from runs r left join (select session_id, count(*) as waves, max(tps_20s) as peak from metrics group by session_id) m on m.session_id = r.session_id left join (select session_id, count(*) filter (where outcome = 'lost') as lost from outcomes group by session_id) o on o.session_id = r.session_id",
    "V03_session_chart": "select session_id, wave, p50, p99, error_rate from metrics order by wave, session_id limit 20000",
    "V04_active_runs": "select session_id, run_group_id, status from runs where run_group_id in (select run_group_id from runs where status not in ('completed', 'failed'))",
    "V05_group_listing": "select r.run_group_id, count(*) as sessions, max(s.s_name) as team_name from runs r left join supplier s on cast(s.s_suppkey as string) = substr(r.run_group_id, 2) group by r.run_group_id order by r.run_group_id desc limit 200",
    "V06_active_group": "select submission_id, min(run_group_id) as run_group_id from runs where status not in ('completed', 'failed') group by submission_id",
    "V07_lookup": "select * from scores where run_group_id = 'g7'",
    "M01_rate": "select name, label, date_trunc('hour', ts) as hour, cast(sum(step) as double) / 3600 as rate from counter_steps group by name, label, date_trunc('hour', ts)",
    "M03_histogram_quantile": "select session_id, lo + (hi - lo) * (0.95 * total - below) / nullif(cum - below, 0) as p95 from (select q.*, row_number() over (partition by session_id order by hi) as nth from (select session_id, e.lo, e.hi, cast(count(*) filter (where v <= e.hi) as double) as cum, cast(count(*) filter (where v <= e.lo) as double) as below, cast(count(*) as double) as total from (select session_id, v from samples where metric = 'service') s cross join (select 0.0 as lo, 50000.0 as hi union all select 50000.0, 100000.0 union all select 100000.0, 150000.0 union all select 150000.0, 200000.0 union all select 200000.0, 1000000.0) e group by session_id, e.lo, e.hi) q where cum >= 0.95 * total) z where nth = 1",
    "M05_gauge_ratio": "select a.label, cast(a.latest as double) / greatest(b.latest, 1) as ratio from (select label, max_by(counter_value, event_id) as latest from metric_samples where name = 'error' group by label) a join (select label, max_by(counter_value, event_id) as latest from metric_samples where name = 'view' group by label) b on b.label = a.label",
    "M07_held_alert": "select name, label, min(hour_no) as since, count(*) as held from (select d.*, hour_no - row_number() over (partition by name, label order by hour_no) as run from (select name, label, unix_timestamp(ts) div 3600 as hour_no from counter_steps group by name, label, unix_timestamp(ts) div 3600 having sum(step) > 0) d) q group by name, label, run having count(*) >= 3",
    "M08_absent": "select c.name, c.label, c.hour from (select n.name, n.label, h.hour from (select distinct name, label from metric_samples) n cross join (select distinct date_trunc('hour', ts) as hour from metric_samples) h) c where not exists (select 1 from metric_samples s where s.name = c.name and s.label = c.label and date_trunc('hour', s.ts) = c.hour)",
    "M09_sum_of_increases": "select label, cast(sum(step) as bigint) as total from counter_steps where name in ('error', 'click') group by label having sum(step) > 0",
    "M11_log_filter": "select service_name, level, ts, http_path from logs where level in ('ERROR', 'WARN') and service_name like 'svc%' and http_path <> ''",
    "M13_histogram_edges": "select e.le, count(*) filter (where s.v <= e.le) as cum from samples s cross join (select 10000 as le union all select 50000 union all select 100000 union all select 250000 union all select 500000 union all select 1000000 union all select 5000000) e group by e.le",
    "M14_sweep_verdict": "select session_id, wave, case when responded < 0.4 * offered then 'STALL' when timed_out + rejected < 50 then 'CLEAN' else 'LOSSY' end as verdict from window_counters",
    "M15_last_clean": "select session_id, max(wave) filter (where responded >= 0.4 * offered and timed_out + rejected < 50) as last_clean from window_counters group by session_id",
}

_md5 = "('0x' || substr(md5(order_id), 1, 15))::bigint"

#: Views whose oracle form is plainer: one ranking, and messages written from the orders.
ORACLE_VIEWS = {
    "samples": """
select session_id, wave, 'service' as metric, greatest(t7 - t3, 1) as v from first_acks
union all select session_id, wave, 'match', greatest(t7 - t3, 1) from live_acks where liquidity_ind = 2
union all select session_id, wave, 'response', greatest(r9 - t0, 1) from sent_waves where not timed_out and r9 > t0
union all select session_id, wave, 'slip', greatest(t1 - t0, 1) from sent_waves where t1 >= t0""",
    "wave_load": f"select scenario, wave, cast(sum(target_rps * (least(start_offset_ns + duration_ns, (wave + 1) * {WAVE_NS}) - greatest(start_offset_ns, wave * {WAVE_NS})) // 1000000000) as bigint) as offered_orders from tasks t, range(0, 1000) r(wave) where wave * {WAVE_NS} < start_offset_ns + duration_ns and (wave + 1) * {WAVE_NS} > start_offset_ns group by scenario, wave",
    "wave_texts": "select run_group_id, session_id, string_agg(wave || ':' || offered_orders || ':' || coalesce(reason, 'pass'), ' ' order by wave) as waves from climbed where wave <= coalesce(first_fail, wave) group by run_group_id, session_id",
    "session_texts": "select g.run_group_id, string_agg(g.session_id || '[' || coalesce(w.waves, '') || ']', ' ' order by g.session_id) as sessions from graded_sessions g left join wave_texts w on w.session_id = g.session_id group by g.run_group_id",
    "board": "select s.*, row_number() over (order by disqualified, peak_sustained_tps desc, p99_at_peak_ns, spike_recovery_ns, total_correctness desc, run_group_id) as place from scores s",
    "messages": "select session_id, 'out' as direction, t7 as at_ns, '8' as msg_type, order_id as cl_ord_id, '' as orig_id, exec_type, fill_qty from orders_acked union all select session_id, 'in', t1, case payload_type when 'CANCEL' then 'F' when 'REPLACE' then 'G' else 'D' end, order_id, orig_order_id, '', 0 from orders_sent",
}

#: Statements for the other engine, over the same views.
ORACLES = {
    "C07_unmatched": "select session_id, order_id as cl_ord_id, t7 as at_ns from orders_acked anti join (select session_id, order_id from orders_sent) s using (session_id, order_id)",
    "M07_held_alert": "select name, label, min(hour_no) as since, count(*) as held from (select d.*, hour_no - row_number() over (partition by name, label order by hour_no) as run from (select name, label, cast(floor(epoch(ts) / 3600) as bigint) as hour_no from counter_steps group by 1, 2, 3 having sum(step) > 0) d) q group by name, label, run having count(*) >= 3",
    # Written from the rule, another way than the query.
    "W13_rank_change": "select run_group_id, publication, place, coalesce(lag(place) over (partition by run_group_id order by publication) - place, 0) as rank_delta from (select run_group_id, 1 as publication, row_number() over (order by p99_at_peak_ns, run_group_id) as place from scores union all select run_group_id, 2, place from board) q",
    "J12_unscored": "select run_group_id from (select distinct run_group_id from runs) r where run_group_id in ('g2', 'g4')",
    "A06_snapshot": "select m.session_id, r.contestant_id, m.wave, m.p50, p90, m.p99, p999, rt_p50, rt_p90, rt_p99, cast(tps_20s as double) / 20 as tps, error_rate from metrics m join runs r on r.session_id = m.session_id and r.contestant_id <> '' join (select session_id, wave, min(bucket_hi) filter (where metric = 'service' and cum >= ceil(0.9 * total)) as p90, min(bucket_hi) filter (where metric = 'service' and cum >= ceil(0.999 * total)) as p999, coalesce(min(bucket_hi) filter (where metric = 'response' and cum >= ceil(0.5 * total)), 0) as rt_p50, coalesce(min(bucket_hi) filter (where metric = 'response' and cum >= ceil(0.9 * total)), 0) as rt_p90, coalesce(min(bucket_hi) filter (where metric = 'response' and cum >= ceil(0.99 * total)), 0) as rt_p99 from cumulative group by session_id, wave) q on q.session_id = m.session_id and q.wave = m.wave",
    "A25_overfill": "select s.session_id, s.order_id from orders_sent s join (select session_id, order_id, sum(fill_qty) as filled from orders_acked group by session_id, order_id) a using (session_id, order_id) where filled > qty",
    "W03_first_response": "select session_id, order_id, min(struct_pack(t7 := t7, exec_type := exec_type)).exec_type as exec_type, min(t7) as t7 from live_acks group by session_id, order_id",
    "J06_phantoms": "select session_id, order_id, count(*) as phantom_fills from orders_acked anti join orders_sent using (session_id, order_id) where fill_qty > 0 and exec_type in ('1', '2', 'F') group by all",
    "J01_outcomes": "select session_id, order_id, outcome, n_acks, filled from outcomes union all select session_id, order_id, 'unsent', count(*), cast(sum(fill_qty) as bigint) from (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from orders_acked a where not exists (select 1 from orders_sent s where s.session_id = a.session_id and s.order_id = a.order_id)) d group by session_id, order_id",
    "A11_wave_input": "select wave, max(p99) as max_p99, max(error_rate) as max_error, avg(tps_20s) as avg_tps from metrics group by wave",
    "A12_upper_median": "select wave, count(*) as n, list_sort(list(p99))[count(*) // 2 + 1] as median_p99 from metrics group by wave",
    "A28_stream_counts": "select s.session_id, count(*) as sent, sum(coalesce(n, 0))::bigint as acked, count(n) as matched, count(*) filter (where n is null and timed_out) as lost, count(*) filter (where n is null and not timed_out) as gaps from orders_sent s left join (select session_id, order_id, count(*) as n from (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from orders_acked) group by all) a using (session_id, order_id) group by s.session_id",
    "W14_elapsed": "select s.session_id, s.order_id, s.t0 - f.first as elapsed_ns from orders_sent s join (select session_id, min(t0) as first from orders_sent group by session_id) f using (session_id)",
    "W02_rank_of": "select b.run_group_id, 1 + (select count(*) from board a where a.place < b.place) as place from board b where b.run_group_id = 'g7'",
    "U02_touched_waves": f"select session_id, wave from sent_waves where t0 >= {B} and t0 <= {B + 60 * SECOND_NS} group by all",
    "P04_wave_index": f"select session_id, order_id, (t0 - {B}) // {WAVE_NS} as wave from orders_sent",
    "P12_json_fields": "select order_id, fill_qty, exec_type from orders_acked",
    "P16_shard": f"select order_id, {_md5} % 24 as shard, (task_id * 4 + {_md5} % 4) % 24 as banded from orders_sent",
    "P17_uuid_time": "select order_id, t0 // 1000000 as ms from orders_sent",
    "P18_protocol_list": "select team_name, concat('FIX,', case when disqualified then 'FIX' else 'REST' end, ',', upper(contestant_id)) as protocols, disqualified as has_repeats from scores",
    "P11_fix_fields": "select session_id, 'out' as direction, t7 as at_ns, '8' as msg_type, order_id as cl_ord_id, '' as orig_id, exec_type, fill_qty from orders_acked union all select session_id, 'in', t1, case payload_type when 'CANCEL' then 'F' when 'REPLACE' then 'G' else 'D' end, order_id, orig_order_id, '', 0 from orders_sent",
    "A05_second_slices": f"select session_id, wave, t7 - t7 % {SECOND_NS} as second_ns, bucket_hi, count(*) as n from (select a.*, ((v >> b) << b) + (1::bigint << b) - 1 as bucket_hi from (select a.*, greatest(t7 - t3, 1) as v, greatest(length(bin(greatest(t7 - t3, 1) | 2047)) - 11, 0)::int as b from first_acks a) a) q group by all",
}
