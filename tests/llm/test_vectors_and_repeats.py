"""Vector codes, clustering and suffix deduplication against brute force, on edge rows and on the sample tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from wavegrade.llm import grid_codes, oracles, queries, suffix_dedup, table_means

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, v int, salt string, cluster string"


def vectors(n, length=64, seed=1, big=0.0):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.normal(0, 0.2, length).astype(np.float32)], int(i % 3) if i % 5 else None, 1, "x", None) for i in range(n)]
    return [(i, [float(np.float32(x * big)) for x in v] if big and i % 4 == 0 else v, *rest) for i, v, *rest in out]


def odd_rows(length=64):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1, 1, None, None), (901, [], 1, 1, None, None), (902, [nan] * length, 1, 1, None, None), (903, [inf] + [0.0] * (length - 1), 1, 1, None, None), (904, [None] + [0.0] * (length - 1), None, 1, None, None), (905, [1.0] * 7, 1, 1, None, None)]


def floors(rows, scale, length):
    return [(r[0], [math.floor(x * scale) for x in r[1]], r[2]) for r in rows if r[1] and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]


def nearest(v, cs):
    ds = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
    return ds.index(min(ds)), min(ds)


def moved(cs, vs, at):
    out = []
    for k, c in enumerate(cs):
        mine = [v for v, a in zip(vs, at) if a == k]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
    return out


def brute_clusters(rows):
    kept = floors(rows, 1024, 64)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs, vs = [r[1] for r in order[:8]], [r[1] for r in kept]
    for _ in range(10):
        cs = moved(cs, vs, [nearest(v, cs)[0] for v in vs])
    got = [nearest(v, cs) for v in vs]
    total = sum(d for _, d in got)
    return sorted((repr(r[0]), k, min(d, 2**63 - 1), min(sum(e for j, e in got if j == k), 2**63 - 1), min(total, 2**63 - 1), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for r, (k, d) in zip(kept, got))


def brute_codes(rows, length=64):
    kept, w = floors(rows, 4096, length), length // 8
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    split = lambda v, p: v[p * w : (p + 1) * w]
    books = [[split(r[1], p) for r in order[:16]] for p in range(8)]
    for _ in range(6):
        books = [moved(books[p], [split(r[1], p) for r in kept], [nearest(split(r[1], p), books[p])[0] for r in kept]) for p in range(8)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [[nearest(split(r[1], p), books[p]) for p in range(8)] for r in kept]
    errors = [sum(d for _, d in g) for g in got]
    by_label: dict = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    top = 2**63 - 1  # the greatest long stands for more
    return sorted((repr(r[0]), "".join(f"{k:02x}" for k, _ in g), min(e, top), min(by_label[r[2]], top), digest) for r, g, e in zip(kept, got, errors))


def shape(df, cols):
    return sorted((repr(r["vec_id"]), *(r[c] for c in cols)) for r in df.collect())


CLUSTER, CODE = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), ("code", "error", "label_error", "codebooks_sha256")
CASES = {
    "usual": vectors(120) + odd_rows(),
    "few": vectors(3) + odd_rows(),
    "repeated": vectors(20) * 3 + vectors(9) + [(None, vectors(1, seed=9)[0][1], None, 1, None, None)] * 2,
    "equal": [(i, [0.25] * 64, 7, 1, None, None) for i in range(30)],
    "large": vectors(40, big=1e7),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_clusters(spark, case):
    assert shape(table_means.cluster(spark.createDataFrame(CASES[case], ROWS)), CLUSTER) == brute_clusters(CASES[case])


@pytest.mark.parametrize("case", sorted(CASES))
def test_codes(spark, case):
    assert shape(grid_codes.compress(spark.createDataFrame(CASES[case], ROWS)), CODE) == brute_codes(CASES[case])


@pytest.mark.parametrize("rows", [[], odd_rows()[:5]])
def test_no_vectors(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert table_means.cluster(df).columns == ["vec_id", *CLUSTER] and table_means.cluster(df).count() == 0
    assert grid_codes.compress(df).columns == ["vec_id", *CODE] and grid_codes.compress(df).count() == 0


def test_cells_leave_out_only_what_cannot_be_nearest():
    rng = np.random.default_rng(3)
    book = rng.integers(-500, 500, (16, 8))
    grid, parts = grid_codes.Grid(book), np.concatenate([rng.integers(-800, 800, (4000, 8)), np.repeat(book, 2, 0)])
    assert grid.edge < 1000
    for _ in range(2):  # the second time from memory
        index, distance = grid.nearest(parts)
        exact = ((parts[:, None, :] - book) ** 2).sum(2)
        assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert grid.met > 0 and grid.evaluated < 2 * len(parts) * 16


def brute_repeats(rows):
    first, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - 49 if i is not None else 0):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((repr(i), len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def repeats(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, tag int, bucket string, runs string")
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **options).collect())


def passages():
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "delté", "eps", "zêta"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, copy = some(30), some(60)
    rows = [(k * 7 % 101, some(rng.randint(1, 12)) + passage + some(rng.randint(1, 12))) for k in range(101)]
    rows += [(200 + k, copy) for k in range(5)] + [(300 + k, copy[k:]) for k in range(4)] + [(400, copy + copy)]
    rows += [(500, "a" * 49), (501, "a" * 50), (502, "a" * 500), (503, "b" * 49), (504, None), (505, ""), (None, copy), (None, None), (201, passage), (200, copy), (200, some(40)), (-5, copy[:55])]
    rows += [(600, "\0" * 60), (601, "x\0" + "\0" * 60)]
    return rows


@pytest.mark.parametrize("hot_runs", [100_000, 10])
def test_repeats(spark, hot_runs):
    rows = passages()
    assert repeats(spark, rows, hot_runs=hot_runs, bucket_bytes=500) == brute_repeats(rows)


def test_repeats_with_a_limit_that_no_hash_may_pass(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", 1 << 40)
    rows = passages()[:60]
    assert repeats(spark, rows, hot_runs=0) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert repeats(spark, []) == [] and repeats(spark, [(None, None), (3, "")]) == brute_repeats([(None, None), (3, "")])


def test_a_long_text(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(9, long), (3, long[300_000:300_120]), (12, "zz" + long[600_000:])]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_sorting():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(1500)) * 2 + b"c" * 120
    at = np.arange(len(data) - 49)
    order, heads = suffix_dedup.deep_shallow(data, at)
    found = [data[p : p + 50] for p in order]
    assert found == sorted(found) and [found[h] for h in heads[:-1]] == sorted(set(found)) and sorted(order) == at.tolist()
    keys = [bytes(rng.choice(b"xyz") for _ in range(5)) for _ in range(300)]
    groups = suffix_dedup.blind_trie(keys)
    assert [keys[g[0]] for g in groups] == sorted(set(keys)) and all(keys[i] == keys[g[0]] for g in groups for i in g) and sum(map(len, groups)) == 300


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_statements(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    found = con.execute(oracles.SQL[name])
    assert sorted(c[0] for c in found.description) == sorted(got.columns)
    names = [c[0] for c in found.description]
    assert sorted(tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall()) == sorted(tuple(r) for r in got.collect())
