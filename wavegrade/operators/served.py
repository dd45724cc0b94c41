"""Registered queries of boards, lists, lookups and admission, with oracles from the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wavegrade.operators import admission, boards
from wavegrade.operators.feeds import query, view
from wavegrade.sources.views import SECOND_NS

_group_no = "cast(substr(run_group_id, 2) as bigint)"
VIEWS = {
    "board_scores": f"select s.*, concat('sub', cast({_group_no} % 50 as string)) as submission_id, {_group_no} * 7919 % 100003 as computed_at from scores s",
    "named_scenarios": "select scenario_id, concat(scenario_id, ' load') as name from scenarios",
    "run_group_rows": f"select run_group_id, concat('sub', cast({_group_no} % 50 as string)) as submission_id, contestant_id, {_group_no} * 31 % 997 as created_at from scores",
    "submission_teams": "select submission_id, max(team_name) as team_name from board_scores where submission_id <> 'sub7' group by submission_id",
    "declarations": f"""
select run_group_id, case {_group_no} % 7 when 0 then ' all ' when 1 then 'fix, Rest' when 2 then 'WS' when 3 then 'FIX,ALL' when 4 then 'ws,fix,WS' when 5 then '' else concat('rest,', contestant_id, ',rest') end as declared from scores""",
    # Ids of 100 bytes and more, of 66 and 64 bytes in characters of two, and empty ones.
    "odd_ids": "select session_id, case cast(order_id as bigint) % 31 when 0 then repeat(order_id, 100) when 1 then repeat('é', 33) when 2 then repeat('é', 32) when 3 then '' else order_id end as cl_ord_id from orders_sent",
    "repeated_messages": """
select session_id, order_id as cl_ord_id, 'request' as class, t1 as at_ns, cast(order_id as bigint) % 29 = 3 as reordered from orders_sent
union all select session_id, order_id, 'request', t1 + 1000, cast(order_id as bigint) % 3 = 0 from orders_sent where cast(order_id as bigint) % 23 = 2
union all select session_id, order_id, 'response', t7, false from orders_acked""",
    # An answer after more than a second is late, after more than five an anomaly; orders without an answer count as capture gaps in
    # sessions from 13 on, in the others as lost.
    "graded_orders": f"""
select s.session_id, s.order_id, a.order_id is not null as answered, cast(substr(s.session_id, 2) as bigint) > 12 as gappy, a.wait
from orders_sent s left join (select session_id, order_id, max(t7 - t3) as wait from slow_acks group by session_id, order_id) a on a.session_id = s.session_id and a.order_id = s.order_id""",
    "doubts": f"""
select session_id, count(*) filter (where answered and wait > {SECOND_NS} and wait <= {5 * SECOND_NS}) as late, count(*) filter (where answered and wait > {5 * SECOND_NS}) as anomalies,
       count(*) filter (where answered) as applied, count(*) filter (where answered or not gappy) as scored, count(*) filter (where not answered and gappy) as gaps from graded_orders group by session_id""",
}

_ranked = "select row_number() over (order by disqualified, peak_sustained_tps desc, p99_at_peak_ns, spike_recovery_ns, total_correctness desc, run_group_id) as rank, b.* from board_scores b"
#: Sort field, direction, and the order that they mean.
_sorts = (
    ("", "", "rank"), ("nonsense", "desc", "rank desc"), ("Peak-TPS", "", "peak_sustained_tps desc, p99_at_peak_ns, spike_recovery_ns, total_correctness desc"), ("p99", "", "p99_at_peak_ns, peak_sustained_tps desc, spike_recovery_ns, total_correctness desc"),
    ("spike_recovery", "desc", "spike_recovery_ns desc, peak_sustained_tps desc, p99_at_peak_ns, total_correctness desc"), ("correctness", "", "total_correctness desc, peak_sustained_tps desc, p99_at_peak_ns, spike_recovery_ns"), ("team_name", "desc", "team_name desc, rank"), ("computed_at", "", "computed_at desc, rank"),
)


@query(" union all ".join(f"select * from (select {n} as sort_no, run_group_id, rank, row_number() over (order by disqualified, {order}, run_group_id) as position from ({_ranked}) r) q where position <= 500" for n, (_, _, order) in enumerate(_sorts)))
def L01_board_sorts(spark, sf_dir):
    rows = boards.ranked(view(spark, sf_dir, "board_scores"))
    pages = [boards.page(rows, boards.board_order(field, direction), boards.MOST_ROWS).select(F.lit(n).alias("sort_no"), "run_group_id", "rank", "position") for n, (field, direction, _) in enumerate(_sorts)]
    return reduce(lambda a, b: a.unionByName(b), pages)


_place = "row_number() over (order by disqualified, rank, run_group_id)"


@query(f"select run_group_id, position, case when (select count(*) from board_scores) > to_row then to_row end as next_offset from (select q.*, ((position - 1) // 40 + 1) * 40 as to_row from (select run_group_id, {_place} as position from ({_ranked}) r) q) z where position <= 120")
def L02_pages(spark, sf_dir):
    rows = boards.ranked(view(spark, sf_dir, "board_scores"))
    return reduce(lambda a, b: a.unionByName(b), [boards.page(rows, boards.board_order(), 40, offset).select("run_group_id", "position", "next_offset") for offset in (0, 40, 80)])


_board = f"select r.* from ({_ranked}) r where team_name ilike '%CUSTOMER#0000000%' and exists (select 1 from group_sessions g join named_scenarios n on n.scenario_id = g.scenario_id where g.run_group_id = r.run_group_id and n.name = 'ramp load')"


@query(f"select run_group_id, rank, team_name, p99_at_peak_ns, position from (select b.*, row_number() over (order by disqualified, p99_at_peak_ns, peak_sustained_tps desc, spike_recovery_ns, total_correctness desc, run_group_id) as position from ({_board}) b) q where position <= 50")
def V01_filtered_board(spark, sf_dir):
    see = lambda name: view(spark, sf_dir, name)
    found = boards.leaderboard(see("board_scores"), see("group_sessions"), see("named_scenarios"), team_name="CUSTOMER#0000000", scenario="ramp load", sort="p99", limit=50)
    return found.select("run_group_id", "rank", "team_name", "p99_at_peak_ns", "position")


@query("select g.run_group_id, g.contestant_id, coalesce(t.team_name, '') as team_name, created_at from run_group_rows g left join submission_teams t on t.submission_id = g.submission_id where g.submission_id in ('sub3', 'sub7', 'sub11', 'sub20') and (g.contestant_id ilike '%C1%' or coalesce(t.team_name, '') ilike '%C1%') order by created_at desc, run_group_id limit 100")
def V05_group_search(spark, sf_dir):
    found = boards.run_groups(view(spark, sf_dir, "run_group_rows"), view(spark, sf_dir, "submission_teams"), submission_ids=["sub3", "sub7", "sub11", "sub20"], search="C1")
    return found.select("run_group_id", "contestant_id", "team_name", "created_at")


@query("select 'run' as kind, session_id as id, status as told from runs where session_id in ('s3', 's17') union all select 'run group', run_group_id, contestant_id from run_group_rows where run_group_id in ('g7', 'g30') union all select 'submission', submission_id, team_name from submission_teams where submission_id in ('sub1', 'sub7') union all select 'score', run_group_id, team_name from board_scores where run_group_id in ('g7', 'nobody')")
def V07_lookups(spark, sf_dir):
    found = (("run", "runs", "session_id", ("s3", "s17"), "status"), ("run group", "run_group_rows", "run_group_id", ("g7", "g30"), "contestant_id"), ("submission", "submission_teams", "submission_id", ("sub1", "sub7"), "team_name"), ("score", "board_scores", "run_group_id", ("g7", "nobody"), "team_name"))
    return reduce(lambda a, b: a.unionByName(b), [boards.lookup(view(spark, sf_dir, rows), key, *ids).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(told).alias("told")) for kind, rows, key, ids, told in found])


@query(f"select run_group_id, case {_group_no} % 7 when 0 then 'FIX,REST,WS' when 1 then 'FIX,REST' when 2 then 'WS' end as protocols, case {_group_no} % 7 when 3 then 'invalid' when 4 then 'duplicate' when 5 then 'invalid' when 6 then 'invalid' else '' end as problem from scores")
def P18_protocols(spark, sf_dir):
    return admission.protocols(view(spark, sf_dir, "declarations")).select("run_group_id", F.array_join("protocols", ",").alias("protocols"), "problem")


@query("select session_id, count(*) filter (where strlen(cl_ord_id) between 1 and 64) as admitted, count(*) filter (where strlen(cl_ord_id) > 64) as too_long, count(*) filter (where cl_ord_id = '') as empty from odd_ids group by session_id")
def P34_ids_by_bytes(spark, sf_dir):
    return admission.admitted(view(spark, sf_dir, "odd_ids"), "cl_ord_id", ["session_id"])


@query("select s.session_id, s.order_id as cl_ord_id, min(a.t7) - min(s.t1) as service_ns, case when cast(s.order_id as bigint) % 23 = 2 then 1 else 0 end as retransmissions, cast(s.order_id as bigint) % 29 = 3 or cast(s.order_id as bigint) % 23 = 2 and cast(s.order_id as bigint) % 3 = 0 as reordered from orders_sent s join orders_acked a on a.session_id = s.session_id and a.order_id = s.order_id group by s.session_id, s.order_id")
def C06_matched_requests(spark, sf_dir):
    return admission.matched(view(spark, sf_dir, "repeated_messages"))


@query(f"select session_id, gapped or slow as tainted, case when gapped then printf('{admission.CAPTURE_LOST}', gaps, scored + gaps, 100.0::double * gaps / (scored + gaps)) when slow then printf('{admission.UNRELIABLE}', late, anomalies, applied, 0.001::double) else '' end as reason from (select d.*, gaps > 0.01 * (scored + gaps) as gapped, late + anomalies > 0.001 * applied as slow from doubts d) q")
def A26_taint_reasons(spark, sf_dir):
    return admission.taint(view(spark, sf_dir, "doubts")).select("session_id", "tainted", "reason")
