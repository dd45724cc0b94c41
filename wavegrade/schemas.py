"""The event and table schemas, written out; nothing is inferred."""

SENT = "order_id string, task_id int, t0 long, t1 long, r9 long, timed_out boolean, price long, qty long, side string, payload_type string, ord_type string, orig_order_id string, smp_id long"
SENT_BATCH = f"session_id string, contestant_id string, barrier_epoch_ns long, events array<struct<{SENT.replace(' string', ':string').replace(' int', ':int').replace(' long', ':long').replace(' boolean', ':boolean')}>>"
ACKED = "order_id string, src_ip long, src_port long, tcp_seq long, t3 long, t7 long, exec_type string, fill_qty long, fill_price long, liquidity_ind int"
ACKED_BATCH = f"session_id string, contestant_id string, events array<struct<{ACKED.replace(' string', ':string').replace(' int', ':int').replace(' long', ':long')}>>"
RUN_STATUS = "session_id string, status string, message string, at_ns long"
CORRECTNESS = "session_id string, correctness_score double, scored long, dirty long, at_ns long"
ASSIGNMENT = "session_id string, band int, tasks array<struct<task_id:long,target_rps:long>>, at_ns long"
BOARD_UPDATE = "run_group_id string, contestant_id string, place long, peak_sustained_tps long"
LOG_LINE = "level string, http_path string"
