"""The field, the language model, benchmark parts and the shard store against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from wavegrade.llm import fm_decontaminate, language_fusion, lbl_score, pii_semicrf, tiered_shards
from wavegrade.llm.common import folded

SF = "/root/testdata/sf0.001"


def every_segmentation(t, field, free):
    """The best score over all segmentations, by enumeration."""
    i, j, scores = field.segments(t, 0, t.n, free)
    by_start = {}
    for a, b, s in zip(i.tolist(), j.tolist(), scores, strict=True):
        by_start.setdefault(a, []).append((b, s))

    def best(at, before):
        if at == t.n:
            return 0.0, ()
        found = [(field.follows[before, pii_semicrf.FREE] + best(at + 1, pii_semicrf.FREE)[0], best(at + 1, pii_semicrf.FREE)[1])]
        for b, s in by_start.get(at, []):
            for y in range(pii_semicrf.FREE):
                rest = best(b, y)
                found.append((field.follows[before, y] + s[y] + rest[0], ((y, at, b), *rest[1])))
        return max(found, key=lambda x: x[0])

    return best(0, pii_semicrf.FREE)


@pytest.mark.parametrize("seed", range(6))
def test_joint_search_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    field = pii_semicrf.Field(rng.normal(0, 1, (len(pii_semicrf.TYPES), len(pii_semicrf.NAMES))), rng.normal(0, 1, (pii_semicrf.FREE + 1,) * 2))
    t = pii_semicrf.Tokens("tel 030 1234 5678, 99 88")
    free = np.zeros(t.n + 1, np.int64)
    assert tuple(field.best(t, free)) == every_segmentation(t, field, free)[1]


def test_expected_counts_sum_to_the_likelihood_of_all():
    rng = np.random.default_rng(1)
    t = pii_semicrf.Tokens("call 555 123 4567 now")
    lattice = pii_semicrf.Lattice([(t, [])])
    w, f = rng.normal(0, 0.5, (len(pii_semicrf.TYPES), len(pii_semicrf.NAMES))), rng.normal(0, 0.5, (pii_semicrf.FREE + 1,) * 2)
    total, chance, pairs = lattice.expected(w, f)
    assert np.isfinite(total).all() and (chance >= 0).all() and (chance <= 1 + 1e-9).all()
    covered = (chance.sum(1) * (lattice.j - lattice.i)).sum()
    assert math.isclose(pairs[0, :, pii_semicrf.FREE].sum() + covered, t.n, rel_tol=1e-6)


def test_field_finds_disguised_data_and_leaves_plain_text(spark):
    field = pii_semicrf.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = lambda s: [(k, s[a:b]) for k, a, b in field.spans(s)[1]]
    planted = {"call 5551234567 now": ("phone", "5551234567"), "ring 020 7946 0958": ("phone", "020 7946 0958"), "call 555-123-4567.": ("phone", "555-123-4567"), "host 10[.]0[.]0[.]1 is": ("ip", "10[.]0[.]0[.]1")}
    assert sum(want in found(s) for s, want in planted.items()) >= 3
    plain = ["we met at noon. Then 12345678 people", "in 1999 - 2004 and 2010", "look at this.Then go", "no marks here"]
    assert not any(found(s) for s in plain)
    nobodys = ["at 2024-05-06 12:34:56 we met", "from 12-31-2024 to 01-15-2025", "ISBN 978-3-16-148410-0", "book 0-306-40615-2 is", "commit 24be1f0c9a7d3e5b8c6f4a2d1e0f9b8c7d6a5e4f fixed", "version 10.0.19041.1234 out", "population 12 345 678 in", "md5 d41d8cd98f00b204e9800998ecf8427e"]
    assert not any(found(s) for s in nobodys)
    whole = {"mail joe (at) example (dot) com": "joe (at) example (dot) com", "jane (at) example (dot) org wrote": "jane (at) example (dot) org", "jane AT example DOT org": "jane AT example DOT org", "jane at example dot org said": "jane at example dot org"}
    assert all(found(s) == [("email", want)] for s, want in whole.items())
    assert found("my key: abcdefghijklmnop1qrs") == [("secret", "abcdefghijklmnop1qrs")]


def test_long_runs_of_one_kind_take_time_in_proportion():
    began = time.process_time()
    for text in ("a" * 1_000_000 + " @", "a.b" * 300_000 + "@", "x@" * 300_000, "+1 " + " " * 500_000):
        pii_semicrf.base_spans(text)
        pii_semicrf.examples(text)
    assert time.process_time() - began < 20


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], lbl_score.words_of((r[1] or "").encode())) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = Counter(w for d, ws in rows if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lbl_score.score(docs, folded("doc_id", 5) != 1).collect()}
    for d, ws in rows:
        r = got[d]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    model = lbl_score.Model({w: k for w, k in c.most_common(300)} | {b"": c[b""]}, n + 0.5 * (v + 1))
    every = np.stack([np.full(model.n + 1, 3), np.full(model.n + 1, 5), np.arange(model.n + 1)], 1)
    assert math.isclose((10 ** model.log10(every)).sum(), 1, rel_tol=1e-4)


def test_benchmark_parts_do_not_change_the_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    docs = docs.union(bench.selectExpr("item_id + 100000", "concat('So ', text, ' and ', text)")).union(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"))
    one = sorted(map(repr, fm_decontaminate.find_contamination(docs, bench).collect()))
    assert sorted(map(repr, fm_decontaminate.find_contamination(docs, bench, part_words=1500).collect())) == one
    kept = fm_decontaminate.drop_contaminated(docs, bench).count()
    assert fm_decontaminate.drop_contaminated(docs, bench, part_words=1500).count() == kept < docs.count()


def test_shard_store(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = tiered_shards.ShardStore(spark, str(tmp_path), target=400_000)
    for k in range(6):
        store.append(docs.where(f"doc_id % 6 = {k}").coalesce(1))
    seen, shards = store.manifest()
    assert seen == 6 and len(shards) == 6
    while store.compact(docs.schema) != seen:
        seen = store.manifest()[0]
    after = store.manifest()[1]
    assert len(after) < 6 and all(s["bytes"] <= 400_000 for s in after if s not in shards)
    assert sorted(map(repr, store.read(docs.schema).collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(RuntimeError):
        store.commit(seen - 1, [])  # another writer has that version
    assert store.vacuum(grace_s=-1) == 6 - sum(s in shards for s in after)
    assert store.read(docs.schema).count() == docs.count()


def test_writers_that_stop_midway(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = tiered_shards.ShardStore(spark, str(tmp_path))
    store.append(docs)
    (tmp_path / "manifests" / "v00000002.json").write_text("")
    (tmp_path / "manifests" / "v00000003.json").write_text("[{\"path\": \"x")
    (tmp_path / "manifests" / "_killed.tmp").write_text("[")
    assert store.manifest()[0] == 1 and store.read(docs.schema).count() == docs.count()
    assert store.append(docs) == 4 and store.read(docs.schema).count() == 2 * docs.count()
    with pytest.raises(RuntimeError):
        store.commit(1, [])
    assert sorted(p.name for p in (tmp_path / "manifests").iterdir() if p.suffix == ".tmp") == ["_killed.tmp"]
    assert store.vacuum(grace_s=-1) == 1 and store.vacuum() == 0
    assert store.read(docs.schema).count() == 2 * docs.count()


def test_shards_of_a_table_in_arrivals(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([tuple(None for _ in docs.columns)], docs.schema)).withColumn("shard_id", docs.doc_id * 2)
    store, version = tiered_shards.shard(docs.repartition(3), root=str(tmp_path))
    assert version > 8  # eight arrivals and at least one merge
    assert sorted(map(repr, store.read(docs.schema).collect())) == sorted(map(repr, docs.collect()))
    rows = tiered_shards.placed(docs.repartition(3)).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in docs.collect())
    assert len({(r.shard_id, r.shard_bytes) for r in rows}) == len({r.shard_id for r in rows}) and len({r.version for r in rows}) == 1
    empty, first = tiered_shards.shard(docs.limit(0), root=str(tmp_path / "empty"))
    assert first == 1 and empty.read(docs.schema).count() == 0


def test_page_patterns_equal_plain_ones_and_are_linear():
    rng = random.Random(5)
    pieces = [b"<html", b"<HTML ", b" lang", b"=", b"'de'", b"\"en", b"xlang=fr", b">", b"<", b"<p>", b" ", b"text", b"\n", "\u00e9".encode(), b"-lang = pl"]
    tag, lang = re.compile(rb"<[^>]*>"), re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
    named = 0
    for _ in range(20_000):
        page = b"".join(rng.choices(pieces, k=rng.randrange(14)))
        m = lang.search(page)
        named += m is not None
        assert language_fusion.declared_in(page) == (m and m.group(1)), page
        assert language_fusion.untagged(page) == tag.sub(b" ", page), page
    assert named > 500
    began = time.time()
    for unit in (b"<html ", b"<a ", b"<html lang ", b"<html>", b"lang="):
        language_fusion.declared_in(unit * 200_000)
        language_fusion.untagged(unit * 200_000)
    assert time.time() - began < 20
