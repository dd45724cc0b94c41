"""The named queries, by the identifiers of the operator inventory."""

from wavegrade.sources.views import B, SECOND_NS, WAVE_NS

QUERIES = {
    # Scalar expressions
    "P01_latencies": "select s.session_id, s.order_id, a.service_ns, case when not timed_out and r9 > t0 then r9 - t0 end as response_ns, case when t1 >= t0 then t1 - t0 end as slip_ns from orders_sent s left join (select session_id, order_id, max(greatest(t7 - t3, 0)) as service_ns from orders_acked group by session_id, order_id) a on a.session_id = s.session_id and a.order_id = s.order_id",
    "P02_sample_admission": "select metric, count(*) as n, max(v) as top from samples where v < 68719476736 group by metric",
    "P03_ack_kinds": "select session_id, count(*) filter (where exec_type = '8') as rejects, count(*) filter (where fill_qty > 0 and exec_type in ('1', '2', 'F')) as fills, count(*) filter (where liquidity_ind = 2) as takers from orders_acked group by session_id",
    "P04_wave_index": "select session_id, order_id, wave from sent_waves",
    "P05_second": f"select session_id, t7 - t7 % {SECOND_NS} as second_ns, count(*) as n from orders_acked group by session_id, t7 - t7 % {SECOND_NS}",
    "P06_order_kind": "select session_id, case when payload_type in ('CANCEL', 'REPLACE') then payload_type else ord_type end as kind, count(*) as n from orders_sent group by session_id, case when payload_type in ('CANCEL', 'REPLACE') then payload_type else ord_type end",
    "P07_opposite_side": "select order_id, side, case side when 'BUY' then 'SELL' else 'BUY' end as opposite, case side when 'BUY' then 10000 <= price else 10000 >= price end as crosses_10000 from orders_sent",
    "P09_smp_presence": "select order_id, smp_id, smp_id is not null as has_smp from orders_sent",
    "P15_sequence_compare": "select a.order_id, (a.tcp_seq - 4294960000 + 2147483648 + 4294967296) % 4294967296 - 2147483648 as distance from (select distinct order_id, tcp_seq from orders_acked) a",
    "P20_grading_mode": "select scenario, case when count(*) > 0 and max(target_rps) = 0 then 'full' else 'invariants' end as mode from tasks group by scenario",
    "P22_status_rank": "select submission_status, case submission_status when 'uploaded' then 0 when 'building' then 1 when 'scanned' then 2 when 'ready' then 3 else 4 end as status_rank, submission_status in ('ready', 'failed') as terminal, submission_status in ('uploaded', 'building', 'scanned', 'sbom_ready', 'ready', 'failed') as valid, count(*) as n from status_events group by submission_status",
    "P23_guarded_ratios": "select session_id, wave, case when offered > 0 then cast(timed_out + rejected as double) / offered else 0.0 end as error_rate, case when offered > 0 then least(cast(responded as double) / offered, 1.0) else 0.0 end as coverage from window_counters",
    "P26_optional_filters": "select run_group_id, team_name from scores where lower(team_name) like '%001%' and contestant_id in ('c1', 'c2', 'c3')",
    "P28_units": "select order_id, round(cast(t1 - t0 as double) / 1000.0, 1) as slip_us from orders_sent",
    "P29_rank_band": "select run_group_id, case when place = 1 then 'first' when place <= 3 then 'podium' when place <= 10 then 'top' else 'rest' end as band from board",
    "P30_bucket": "select session_id, metric, bucket_hi, cast(sum(n) as bigint) as n from histograms group by session_id, metric, bucket_hi",
    "P31_log2_bucket": "select order_id, cast(case when t1 = t0 then 0 else length(bin(t1 - t0)) end as bigint) as bucket from orders_sent",
    "P37_sanity_gate": f"select session_id, count(*) filter (where t7x > 0 and (t7x < t3 or t7x - t3 > {15 * SECOND_NS})) as anomalies, count(*) filter (where t7x >= t3 and t7x - t3 <= {15 * SECOND_NS}) as good, count(*) filter (where t7x = 0) as unset from (select session_id, t3, case when cast(order_id as bigint) % 131 = 0 then t7 - 2000000000 when cast(order_id as bigint) % 151 = 0 then 0 else t7 end as t7x from orders_acked) q group by session_id",
    # Joins
    "J01_outcomes": "select coalesce(s.session_id, a.session_id) as session_id, coalesce(s.order_id, a.order_id) as order_id, case when s.order_id is null then 'unsent' when a.order_id is not null then 'matched' when s.timed_out then 'lost' else 'gap' end as outcome, coalesce(n_acks, 0) as n_acks, coalesce(filled, 0) as filled from orders_sent s full outer join (select session_id, order_id, count(*) as n_acks, cast(sum(fill_qty) as bigint) as filled from (select distinct session_id, order_id, exec_type, t3, t7, fill_qty, fill_price from orders_acked) group by session_id, order_id) a on a.session_id = s.session_id and a.order_id = s.order_id",
    "J02_redelivery": "select session_id, count(*) as n from (select distinct session_id, order_id, exec_type, t7, fill_qty, fill_price from (select * from orders_acked union all select * from orders_acked where cast(order_id as bigint) % 50 = 0) u) d group by session_id",
    "J03_exclude_timed_out": "select session_id, order_id, count(*) as n from live_acks group by session_id, order_id",
    "J04_contestant": "select s.session_id, r.contestant_id, count(*) as n from orders_sent s left join runs r on r.session_id = s.session_id group by s.session_id, r.contestant_id",
    "J06_phantoms": "select a.session_id, a.order_id, count(*) as phantom_fills from orders_acked a where a.fill_qty > 0 and a.exec_type in ('1', '2', 'F') and not exists (select 1 from orders_sent s where s.session_id = a.session_id and s.order_id = a.order_id) group by a.session_id, a.order_id",
    "J07_lost": "select session_id, order_id, payload_type from outcomes where outcome = 'lost'",
    "J08_gaps": "select session_id, order_id from outcomes where outcome = 'gap'",
    "J09_run_lookup": "select session_id, run_group_id, submission_id, contestant_id from runs where run_group_id <> ''",
    "J10_scoring_input": "select r.run_group_id, r.session_id, c.scenario_id, c.sort_order, p.sent, p.matched from runs r join scenarios c on c.scenario_id = r.scenario_id join (select session_id, count(*) as sent, count(*) filter (where outcome = 'matched') as matched from outcomes group by session_id) p on p.session_id = r.session_id",
    "J11_team": "select r.run_group_id, max(s_name) as team_name from runs r left join supplier on cast(s_suppkey as string) = substr(r.run_group_id, 2) group by r.run_group_id",
    "J12_unscored": "select distinct run_group_id from runs r where not exists (select 1 from published s where s.run_group_id = r.run_group_id)",
    "J13_ran_scenario": "select distinct r.run_group_id from runs r where exists (select 1 from runs x where x.run_group_id = r.run_group_id and x.scenario_id = 'ramp')",
    "J14_active_groups": "select distinct run_group_id from runs where run_group_id in (select run_group_id from runs where status not in ('completed', 'failed'))",
    "J15_run_detail": "select r.session_id, r.status, c.scenario_id, c.duration_s, m.waves from runs r join scenarios c on c.scenario_id = r.scenario_id left join (select session_id, count(*) as waves from metrics group by session_id) m on m.session_id = r.session_id",
    "J17_wave_load": "select scenario, wave, offered_orders from wave_load",
    "J18_schedule_check": "select r.session_id, l.wave, l.offered_orders, m.p99, m.session_id is not null and m.error_rate <= 0.01 and m.p99 <= 1000000 as ok from runs r join wave_load l on l.scenario = r.scenario_id left join metrics m on m.session_id = r.session_id and m.wave = l.wave",
    "J20_active_sessions": "select session_id, contestant_id from runs where status not in ('completed', 'failed') and contestant_id <> ''",
    "J25_contestant_mismatch": "select a.session_id, count(*) as n from orders_acked a join runs r on r.session_id = a.session_id where a.contestant_id <> r.contestant_id group by a.session_id",
    # Aggregations
    "A01_window_counters": "select * from window_counters",
    "A02_distributions": "select * from histograms",
    "A03_quantiles": "select session_id, wave, metric, min(bucket_hi) filter (where cum >= greatest(1, ceil(0.5 * total))) as p50, min(bucket_hi) filter (where cum >= greatest(1, ceil(0.9 * total))) as p90, min(bucket_hi) filter (where cum >= greatest(1, ceil(0.99 * total))) as p99, coalesce(min(bucket_hi) filter (where cum >= greatest(1, ceil(0.999 * total))), 0) as p999 from cumulative group by session_id, wave, metric",
    "A04_merge": "select metric, bucket_hi, cast(sum(n) as bigint) as n from histograms group by metric, bucket_hi",
    "A06_snapshot": "select q.session_id, r.contestant_id, q.wave, p50, p90, p99, p999, rt_p50, rt_p90, rt_p99, cast(c.responded as double) / 20 as tps, case when c.offered > 0 then cast(c.timed_out + c.rejected as double) / c.offered else 0.0 end as error_rate from wave_quantiles q join window_counters c on c.session_id = q.session_id and c.wave = q.wave join runs r on r.session_id = q.session_id and r.contestant_id <> ''",
    "A07_rollup_counters": f"select session_id, wave, t0 - t0 % {SECOND_NS} as second_ns, count(*) as offered, count(*) filter (where timed_out) as errors from sent_waves group by session_id, wave, t0 - t0 % {SECOND_NS}",
    "A09_ten_seconds": f"select r.contestant_id, second_ns - second_ns % {10 * SECOND_NS} as bucket_ns, round(cast(sum(p99) as double) / count(*), 6) as avg_p99, max(n) as max_tps, round(sum(case when offered > 0 then cast(errors as double) / offered else cast(0 as double) end) / count(*), 9) as error_rate from second_rows q join runs r on r.session_id = q.session_id group by r.contestant_id, second_ns - second_ns % {10 * SECOND_NS}",
    "A11_wave_input": "select wave, max(p99) as max_p99, max(error_rate) as max_error, cast(sum(tps_20s) as double) / count(*) as avg_tps from metrics group by wave",
    "A12_upper_median": "select wave, n, p99 as median_p99 from (select wave, p99, row_number() over (partition by wave order by p99, session_id) as nth, count(*) over (partition by wave) as n from metrics) q where nth = (n - n % 2) / 2 + 1",
    "A13_group_correctness": "select r.run_group_id, least(cast(sum(least(filled, qty)) as double) / greatest(cast(sum(filled) as bigint), 1), 1.0) as total_correctness from runs r join outcomes o on o.session_id = r.session_id where r.scenario_id = 'correctness' group by r.run_group_id",
    "A15_coverage_gate": "select run_group_id, count(*) filter (where low) > 0 as incomplete, min_by(session_id, sort_order) filter (where low) as first_failing, min_by(concat('coverage ', cast(matched as string), '/', cast(sent as string)), sort_order) filter (where low) as reason from (select r.run_group_id, r.session_id, c.sort_order, sent, matched, sent > 0 and cast(matched as double) / sent < 0.90 as low from runs r join scenarios c on c.scenario_id = r.scenario_id join (select session_id, count(*) as sent, count(*) filter (where first_t7 - first_t3 < 1000000000) as matched from outcomes group by session_id) o on o.session_id = r.session_id) q group by run_group_id",
    "A18_spike_recovery": f"select session_id, baseline, peak_wave, case when peak <= threshold or baseline = 0 then 0 else (coalesce(min(case when wave > peak_wave and p99 <= threshold then wave end), max(wave) + 1) - peak_wave) * {WAVE_NS} end as recovery_ns from (select q.*, min(case when p99 = peak then wave end) over (partition by session_id) as peak_wave, cast(floor(baseline * 1.1) as bigint) as threshold from (select session_id, wave, p99, max(p99) over (partition by session_id) as peak, first_value(p99) over (partition by session_id order by wave) as baseline from metrics) q) z group by session_id, baseline, peak, peak_wave, threshold",
    "A21_classes": "select session_id, count(*) filter (where filled > qty) as overfill, count(*) filter (where outcome = 'lost' and payload_type <> 'CANCEL') as lost_order, count(*) filter (where outcome = 'lost' and payload_type = 'CANCEL') as lost_cancel from outcomes group by session_id",
    "A22_order_score": "select session_id, case when scored = 0 then 1.0 else cast(scored - dirty as double) / scored end as score from (select session_id, count(*) filter (where outcome <> 'gap') as scored, count(*) filter (where outcome = 'lost' or filled > qty) as dirty from outcomes group by session_id) q",
    "A23_examples": "select session_id, order_id, nth from (select session_id, order_id, row_number() over (partition by session_id order by cast(order_id as bigint)) as nth from outcomes where filled > qty) q where nth <= 100",
    "A25_overfill": "select distinct session_id, order_id from (select a.session_id, a.order_id, s.qty, sum(a.fill_qty) over (partition by a.session_id, a.order_id order by a.t7, a.exec_type, a.fill_qty, a.fill_price rows between unbounded preceding and current row) as cum from orders_acked a join orders_sent s on s.session_id = a.session_id and s.order_id = a.order_id) q where cum > qty",
    "A26_taint": "select session_id, cast(gaps as double) / (scored + gaps) > 0.01 as tainted from (select session_id, count(*) filter (where outcome = 'gap') as gaps, count(*) filter (where outcome <> 'gap') as scored from outcomes group by session_id) q",
    "A28_stream_counts": "select session_id, count(*) as sent, cast(sum(n_acks) as bigint) as acked, count(*) filter (where outcome = 'matched') as matched, count(*) filter (where outcome = 'lost') as lost, count(*) filter (where outcome = 'gap') as gaps from outcomes group by session_id",
    "A29_ready_groups": "select run_group_id from runs group by run_group_id having count(distinct scenario_id) = 4 and bool_and(status in ('completed', 'failed'))",
    "A30_group_status": "select run_group_id, case when count(*) filter (where status = 'completed') = count(*) then 'completed' when count(*) filter (where status = 'requested') = count(*) then 'requested' when count(*) filter (where status = 'failed') > 0 and count(*) filter (where status in ('failed', 'completed')) = count(*) then 'failed' else 'running' end as status from runs group by run_group_id",
    "A32_scenario_load": "select scenario, cast(sum(target_rps) as bigint) as rps, count(*) as n_tasks, cast(sum(target_rps * duration_ns / 1000000000) as bigint) as orders from tasks group by scenario",
    "A36_session_distribution": "select session_id, metric, bucket_hi, cast(sum(n) as bigint) as n from histograms group by session_id, metric, bucket_hi",
    "A38_timeline": "select wave, max(p50) as p50, max(p99) as p99 from metrics group by wave",
    "A39_throughput": "select wave, cast(sum(tps_20s) as bigint) as responded, max(error_rate) as error_rate from metrics group by wave",
    "A40_session_card": "select session_id, max(tps_20s) as peak, count(*) as samples from metrics group by session_id",
    # Windows
    "W01_board_rank": "select run_group_id, place from board",
    "W03_first_response": "select session_id, order_id, exec_type, t7 from first_acks",
    "W04_effective_arrival": "select session_id, order_id, max(t3) over (partition by session_id, src_ip, src_port order by tcp_seq, cast(order_id as bigint) rows between unbounded preceding and current row) as eff_t3 from (select distinct session_id, order_id, src_ip, src_port, tcp_seq, t3 from orders_acked) q",
    "W08_cumulative_fills": "select session_id, order_id, t7, cast(sum(fill_qty) over (partition by session_id, order_id order by t7, exec_type, fill_qty, fill_price rows between unbounded preceding and current row) as bigint) as cum_qty from orders_acked",
    "P33_blanked": "select session_id, wave, second_ns, case when second_ns = max(second_ns) over (partition by session_id, wave) then n end as sketch_total from (select session_id, wave, second_ns, cast(sum(n) as bigint) as n from shard_seconds group by session_id, wave, second_ns) q",
    "W12_newest_wave": "select session_id, max(wave) as wave, max_by(p99, wave) as p99 from metrics group by session_id",
    "W14_elapsed": "select session_id, order_id, t0 - min(t0) over (partition by session_id) as elapsed_ns from orders_sent",
    "W15_counter_delta": "select name, label, event_id, step from counter_steps",
    # Sorting, sets, state
    "L01_board_sort": "select run_group_id, team_name, place from board order by disqualified, team_name, place",
    "L02_page": "select run_group_id, place from board order by place limit 101 offset 100",
    "L07_top_paths": "select http_path, count(*) as n from logs where http_path <> '' group by http_path order by n desc, http_path limit 10",
    "L08_scenarios": "select scenario_id, sort_order from scenarios order by sort_order, scenario_id",
    "U01_union": "select session_id, kind, count(*) as n from (select session_id, 'sent' as kind, t0 as at from orders_sent union all select session_id, 'acked', t3 from orders_acked) u group by session_id, kind",
    "U02_touched_waves": f"select distinct session_id, wave from sent_waves where t0 between {B} and {B + 60 * SECOND_NS}",
    "U03_sessions": "select distinct session_id from orders_acked",
    "T15_changed_only": "select entity_id, event_id from (select s.*, lag(run_status) over (partition by entity_id order by ts, event_id) as before from status_events s) q where before is null or before <> run_status",
    "T20_run_fold": "select entity_id, coalesce(min_by(run_status, event_id) filter (where run_status in ('completed', 'failed')), max_by(run_status, event_id)) as status from status_events group by entity_id",
    "C01_retransmitted": "select flow, direction, cast(sum(greatest(0, least(seq_len, prev_end - seq_start))) as bigint) as repeated_bytes from (select s.*, max(seq_start + seq_len) over (partition by flow, direction order by arrival, seq_start, seq_len rows between unbounded preceding and 1 preceding) as prev_end from capture_segments s) q where prev_end is not null group by flow, direction",
    "C02_gaps": "select flow, direction, cast(sum(greatest(0, seq_start - prev_end)) as bigint) as gap_bytes from (select s.*, max(seq_start + seq_len) over (partition by flow, direction order by seq_start, seq_len, arrival rows between unbounded preceding and 1 preceding) as prev_end from capture_segments s) q where prev_end is not null group by flow, direction",
    "V08_in_flight": "select session_id, run_group_id from runs where status in ('requested', 'queued', 'deploying', 'running')",
    "V09_uniqueness": "select 'group_scenario' as rule, concat(run_group_id, scenario_id) as id, count(*) as n from runs group by run_group_id, scenario_id having count(*) > 1 union all select 'active_group', submission_id, count(distinct run_group_id) from runs where status not in ('completed', 'failed') group by submission_id having count(distinct run_group_id) > 1 union all select 'content', md5(concat(entity_id, run_status)), count(*) from status_events group by md5(concat(entity_id, run_status)) having count(*) > 1",
    # Operational samples and logs
    "M02_increase": "select name, label, cast(sum(step) as bigint) as increase from counter_steps group by name, label",
    "M04_error_ratio": "select label, cast(sum(case when name = 'error' then step else 0 end) as double) / greatest(cast(sum(step) as bigint), 1) as ratio from counter_steps group by label",
    "M06_latest": "select name, label, latest, cast(sum(latest) over (partition by name) as bigint) as of_all from (select name, label, max_by(counter_value, event_id) as latest from metric_samples group by name, label) q",
    "M10_log_volume": "select service_name, level, date_trunc('day', ts) as day, count(*) as n from logs group by service_name, level, date_trunc('day', ts)",
    "M12_errors": "select service_name, count(*) filter (where level = 'ERROR') as errors from logs group by service_name",
}
