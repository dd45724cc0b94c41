"""Cases of the findings of round 3."""

import random
import re
import time

from pyspark.sql import functions as F

from wavegrade.operators import replay
from wavegrade.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_messages_are_parsed_once(spark):
    """A filter or join on a field of a message must not parse it again."""
    got = plan(catalog.queries()["C07_unmatched"](spark, SF)).split("== Optimized Logical Plan ==")[1]
    assert "str_to_map" not in got and "instr" not in got


def test_fields_of_messages(spark):
    """The first of two equal tags counts, tags that end like another are not it, and missing ones are null."""
    from wavegrade.operators.grading import _field

    rows = spark.createDataFrame([("111=a|11=b=c|11=d|35=",)], "msg string").select(F.expr("concat(chr(1), replace(msg, '|', chr(1)))").alias("m"))
    assert tuple(rows.selectExpr(_field(11), _field(111), _field(35), _field(41)).first()) == ("b=c", "a", "", None)


def replayed_seconds(n):
    """n orders of one side at one price, all of them told of a fill that nobody gave: each looks for earlier ones that wait or are evidence."""
    book, fills, t = replay.Session(), [{"qty": 1, "price": 10}], time.process_time()
    for i in range(n):
        list(book.apply(replay.Order({"order_id": str(i), "side": "BUY", "price": 10, "qty": 5, "kind": "LIMIT", "ref_id": None, "smp_id": 1, "eff_t3": 1000 * i, "flow": 1, "fills": fills})))
    rows = list(book.finish())
    assert len(rows) == n and rows[0][COUNT["price_wrong"]] == 1 and sum(r[COUNT["price_wrong"]] for r in rows) == n
    return time.process_time() - t


COUNT = {c: i + 1 for i, c in enumerate(replay.COUNTS)}


def test_the_end_of_a_replay_takes_time_in_proportion():
    """R: orders that still rest at the end don't step over all closed before them."""
    replayed_seconds(2_000)
    assert replayed_seconds(32_000) < 8 * max(replayed_seconds(8_000), 0.02)


def test_replay_passes_over_own_orders_and_keeps_the_queue(spark):
    """Against a plain scan: random books give the same rows as the book whose levels are lists."""
    rng = random.Random(7)
    for _ in range(20):
        book, rest = replay.Session(), []
        for i in range(200):
            side, smp = rng.choice(["BUY", "SELL"]), rng.choice([None, 1, 2])
            kind, ref = rng.choice(["LIMIT"] * 4 + ["MARKET", "CANCEL", "REPLACE"]), str(rng.randrange(max(i, 1)))
            list(book.apply(replay.Order({"order_id": str(i), "side": side, "price": rng.randrange(8, 12), "qty": rng.randrange(1, 9), "kind": kind, "ref_id": ref, "smp_id": smp, "eff_t3": i, "flow": 1, "fills": []})))
            rest = [r for levels in book.levels.values() for level in levels.values() for r in level.values()]
            assert {r.id for r in rest} == set(book.resting) and all(r.left > 0 for r in rest)
            owners = {}
            for r in rest:
                owners[r.side, r.price, r.smp] = owners.get((r.side, r.price, r.smp), 0) + 1
            assert owners == dict(book.owners)


def test_complete_results_do_not_pass_the_driver(spark):
    """A complete stream's result lies in files, not in a table of the driver."""
    got = catalog.queries()["T02_interval_counters"](spark, SF)
    assert got.inputFiles() and "MemoryPlan" not in plan(got)


def test_a_large_shard_is_dealt_to_several_tasks(spark, tmp_path):
    from wavegrade.sources import io

    rows = spark.range(4000).select(F.col("id").cast("string").alias("order_id"))
    io.write_sharded(rows, f"{tmp_path}/t", 2, chunk=10_000, tasks=8)
    found = spark.read.parquet(f"{tmp_path}/t")
    assert found.select("order_id").distinct().count() == found.count() == 4000 and len(found.inputFiles()) == 8


def test_batches_of_one_envelope_are_numbered_by_deals(spark):
    from wavegrade.sources import io

    rows = spark.range(5000).select(F.lit("s").alias("session_id"), F.col("id").alias("t0"))
    got = io.to_batches(rows, ["session_id"], 100, deals=4)
    assert got.selectExpr("max(size(events))").first()[0] == 100 and got.select(F.inline("events")).distinct().count() == 5000
    assert "_deal" in plan(got).split("Window", 1)[1].split("\n")[0]


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    from wavegrade.sources import io

    monkeypatch.setattr(io, "TASK_ROWS", 500)
    got = plan(catalog.queries()["S25_bucketed_outcomes"](spark, SF))
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of", got)[1]) >= 12


def test_shuffles_grow_with_the_rows_and_shrink_again(spark, monkeypatch):
    """J02, S13, A25 and others: rows of a task don't grow with the tables."""
    from wavegrade.sources import io

    catalog.frame(spark, SF, "J02_redelivery")
    own = spark.conf.get("wavegrade.own")
    monkeypatch.setattr(catalog, "_rows", {})
    monkeypatch.setattr(io, "TASK_ROWS", 500)
    catalog.frame(spark, SF, "J02_redelivery")
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 20 and int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 8 << 20
    monkeypatch.setattr(catalog, "_rows", {})
    monkeypatch.setattr(io, "TASK_ROWS", 500_000)
    catalog.frame(spark, SF, "J02_redelivery")
    assert spark.conf.get("spark.sql.shuffle.partitions") == own


def test_every_position_is_learned_from_once():
    """op5: the rounds together train on each position of each text, not on a share of them."""
    import numpy as np

    from wavegrade.llm import lbl_score

    texts = [lbl_score.words_of(b"a b c a"), lbl_score.words_of(b""), lbl_score.words_of(b"c b " * 50)]
    model = lbl_score.Model({b"": 3, b"a": 2, b"b": 51}, 200.0)
    parts = [model.flat(texts[:2]).astype(np.uint16), model.flat(texts[2:]).astype(np.uint16)]
    rows = [tuple(r) for k in range(lbl_score.ROUNDS) for part in lbl_score.stretches(iter(parts), model.n, k) for r in part.tolist()]
    assert sorted(rows) == sorted(map(tuple, model.numbers(texts).tolist())) and len(rows) == sum(map(len, texts))


def test_streams_come_in_step_by_time(spark, monkeypatch):
    """Both streams in as many batches, in the order of time, all rows there."""
    from wavegrade.operators import feeds

    monkeypatch.setattr(feeds, "BATCH_ROWS", 1000)
    monkeypatch.setattr(feeds, "BATCH_FILES", 2)
    few = spark.range(300).select((F.col("id") * 7919 % 300).alias("t"))
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("t"))
    for stream, n in zip(feeds.in_step((few, "t"), (many, "t")), (300, 5000), strict=True):
        seen = []
        sink = lambda batch, _: seen.append(batch.agg(F.min("t"), F.max("t"), F.count("*")).first())  # noqa: E731, B023
        stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", feeds.folder(spark)).start().awaitTermination()
        assert len(seen) == 5 and sum(s[2] for s in seen) == n and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_stream_joins_over_several_batches(spark, monkeypatch):
    """The same rows when state goes between batches, and no more partitions of state than are asked for."""
    from wavegrade.operators import feeds

    names = ("T05_timed_out_marker", "T09_join_window", "T09_outcomes_in_time", "T12_in_flight")
    rows = lambda q: sorted(map(str, catalog.queries()[q](spark, SF).collect()))
    whole, shuffles = {q: rows(q) for q in names}, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(feeds, "BATCH_ROWS", 2000)
    monkeypatch.setattr(feeds, "BATCH_FILES", 2)
    assert {q: rows(q) for q in names} == whole and whole["T09_outcomes_in_time"] == rows("J01_in_time")
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffles


def test_chunks_that_come_once_push_out_no_others(monkeypatch):
    """op10: a chunk is kept from the second time on that its word comes; ids stay those of the library."""
    import numpy as np
    import public_tokenizers

    from wavegrade.llm import curve_pack

    monkeypatch.setattr(curve_pack, "CACHED_CHUNKS", 50)
    found = curve_pack.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghij"
    once = " ".join("q" + "".join(letters[int(d)] for d in str(i)) for i in range(1000))
    texts = ["Again, and again, And again,", once, "Again, x<|endoftext|>y Ünïcode's 12.5"]
    ids = [np.frombuffer(found.encode(x.encode(), 2), "<u4").tolist() for x in texts]
    assert ids == [[*found.library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert b"again," in found.by_chunk.young or b"again," in found.by_chunk.old


def test_rollups_are_dealt_once_by_wave(spark):
    """No shuffle by bucket or second after that by wave."""
    from wavegrade.operators import derived, rollup

    got = plan(rollup.rolled(derived.reported(spark, SF), ["answered"], {"p50": "0.5"})).split("== Physical Plan ==")[1]
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got)
    assert dealt and not any("_bucket" in d for d in dealt)


def test_a_flow_does_not_read_what_waits_when_rows_come():
    """The timer tells the first of the waiting records; new ones move it only if they are earlier."""
    import pandas as pd

    from wavegrade.streaming import live

    class Handle:
        def __init__(self):
            self.timers, self.rows = set(), []

        def getListState(self, *_):
            return self

        getValueState = getListState

        def appendList(self, rows):
            self.rows += rows

        def listTimers(self):
            return iter(sorted(self.timers))

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.add(t)

    handle, flow = Handle(), live.FlowBuffer()
    flow.init(handle)
    for t3, due in ((7_000_000, 8), (9_000_000, 8), (3_000_000, 4)):
        list(flow.handleInputRows(("s", 1, 2), iter([pd.DataFrame({"order_id": ["1"], "tcp_seq": [1], "t3": [t3]})]), None))
        assert handle.timers == {due}
    assert len(handle.rows) == 3


def test_noise_words_are_drawn_by_their_shares():
    """op5: drawn in one step, each word of a class has its share; places without one are never drawn."""
    import numpy as np

    from wavegrade.llm import lbl_score

    share = np.random.default_rng(1).random((5, 16)) ** 6
    share[4, 9:] = 0
    share[3] = 1
    share /= share.sum(1, keepdims=True)
    keep, other = lbl_score.aliases(share)
    drawn = keep.astype(float)
    np.add.at(drawn, other, 1 - keep.astype(float))
    assert np.allclose(drawn.reshape(share.shape) / 16, share, atol=1e-7) and (keep.reshape(5, 16)[4, 9:] == 0).all()


def test_equal_words_after_equal_words_are_scored_once(spark, monkeypatch):
    """op5: texts that say the same again cost no more sums over classes and words, and have the same score."""
    from wavegrade.llm import lbl_score

    texts = [lbl_score.words_of(b"a b c a b d"), lbl_score.words_of(b""), lbl_score.words_of(b"z c b")]
    model = lbl_score.Model({b"": 3, b"a": 2, b"b": 51, b"c": 7}, 200.0)
    own, rows = lbl_score.chosen, []
    monkeypatch.setattr(lbl_score, "chosen", lambda s, *at: rows.append(len(s)) or own(s, *at))
    once = model.log10(model.numbers(texts)).tolist()
    n = sum(rows)
    assert model.log10(model.numbers(texts * 40)).tolist() == once * 40 and sum(rows) == 2 * n


def test_answers_become_a_row_for_each_order_before_they_are_written(spark, monkeypatch):
    """What is written has a row for an order and not for an answer; redelivered fills count once, and an overfill is found after them."""
    from wavegrade.operators import violations
    from wavegrade.sources import io

    own, written = io.stored, []
    monkeypatch.setattr(io, "stored", lambda df, **o: written.append(own(df, **o)) or written[-1])
    sent = spark.createDataFrame([("s", str(i), 100, "NEW", i == 3) for i in range(4)], "session_id string, order_id string, qty long, payload_type string, timed_out boolean")
    fill = lambda order, t7, qty: ("s", order, 1, 2, int(order), 10 * int(order), t7, "F", qty, 5)
    # 0: 60 told three times; 1: 60 told twice, then 50; 2: 100 in 50 fills; 3: nothing; 9: of an order that nobody sent.
    rows = [fill("0", 1, 60)] * 3 + [fill("1", 11, 60)] * 2 + [fill("1", 12, 50)] + [fill("2", 30 + i, 2) for i in range(50)] + [fill("9", 91, 500)]
    acked = spark.createDataFrame(rows, "session_id string, order_id string, src_ip long, src_port long, tcp_seq long, t3 long, t7 long, exec_type string, fill_qty long, fill_price long")
    assert sorted(map(tuple, violations.violations(sent, acked).collect())) == [("s", "1", "overfill", "50"), ("s", "3", "lost_order", "")]
    assert [tuple(r) for r in violations.phantoms(sent, acked).collect()] == [("s", 1)]
    assert written and all(w.count() <= 4 for w in written)
