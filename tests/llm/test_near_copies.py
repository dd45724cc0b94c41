"""The pipeline's near-copy stage against all pairs."""

import random
import re

import corpus_pipeline
import pytest

from wavegrade.llm import simhash_copies

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Rows left when of each component the smallest id stays, null ids last."""
    rows = list(dict.fromkeys(rows))
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = {}
    for k, (d, t) in zip(label, rows, strict=True):
        out.setdefault(k, []).append((d is None, d or 0))
    return sorted((repr(None if min(v)[0] else min(v)[1]) for v in out.values()))


def planted(rng):
    """Copies with a few words changed (J about 0.7 to 0.95), a family that shares its text, texts that share a passage only."""
    word = lambda: "w%d" % rng.randrange(10**6)
    rows, at = [], 10_000_000
    for changes in (1, 1, 2, 2, 3, 4):
        base = [word() for _ in range(100)]
        copy = list(base)
        for k in rng.sample(range(5, 95), changes):
            copy[k] = word()
        rows += [(at, " ".join(base)), (at + 1, " ".join(copy))]
        at += 2
    template = [word() for _ in range(120)]
    for _ in range(40):
        copy = list(template)
        copy[rng.randrange(120)] = word()
        rows.append((at, " ".join(copy)))
        at += 1
    for _ in range(30):
        rows.append((at, " ".join(template[:60] + [word() for _ in range(30)])))
        at += 1
    return rows


EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (4, "Another text under id four"), (None, "a null id"), (None, "a second and longer text under a null id"), (5, "ONE")]


def test_stage_drops_copies_that_differ_in_a_few_words(spark):
    rows = planted(random.Random(3))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == brute_kept(rows)
    assert len(brute_kept(rows)) < len(rows) - 40


@pytest.mark.parametrize("crowd", [4, 256])
def test_stage_equals_all_pairs(spark, crowd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + planted(random.Random(4)) + EDGE
    got = simhash_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == brute_kept(rows)


def test_stage_on_an_empty_table(spark):
    assert simhash_copies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
