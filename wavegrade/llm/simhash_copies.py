"""Near copies by SimHash: the mode of the SimHash operator for a similarity of 0.8 on five-word shingles.

Words are those of the fingerprints (ASCII lower case, words without ASCII white space); a text is its set of
five-word shingles, and texts are linked if their sets have a Jaccard index of 0.8 or more. Each set has a 64-bit
fingerprint (a bit is 1 if set in over half the shingles' hashes). At an index of 0.8 fingerprints differ in some
10 bits, far too many for blocks of equal bits to deal them. So sets are dealt by shingles: two sets of 0.8 or
more share one of the first fifth (and one more) of each in one order for all texts, in which shingles that a
sample shows to be common come last; the order decides speed only. Within a shingle's group a BK-tree over the
fingerprints finds the pairs within RADIUS bits (in groups of up to FEW, plain comparison), sizes and the places
of the shared shingle rule out others, and the pairs that are left are compared in full, shingle by shingle.
Sets of under SURE shingles, whose fingerprints scatter, are compared whatever their bits.

In a group of over CROWD sets each is first compared with one set of about its size and with its neighbours in eight
orders of the fingerprints; when that has joined the near copies to components, pairs of different components are
searched, so that a large family is not squared.

Edge cases: null, empty and blank texts have the empty set and are copies of one another; under five words the
whole sequence is the only shingle; of each component the row with the smallest id stays, null ids coming last; rows
that share an id but not a text are rows of their own; of rows equal in id and text one stays; an empty table gives
an empty one; all columns pass as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, release, whole, written
from wavegrade.llm.simhash_bk import SEED, BKTree, bits_over_half, components, shingle_hashes

WIDTH, CROWD, FEW = 5, 32, 16
#: Bits that fingerprints of near copies differ in at most (10 are expected at an index of 0.8, 22 are over four deviations more), and the size from which that holds.
RADIUS, SURE = 22, 32
#: The parity of a set's shingles in 512 cells; sketches differ in no more cells than the sets in shingles, and near copies in a ninth of both sizes' sum at most.
SKETCH = [f"s{k}" for k in range(8)]
#: Texts sampled for the order, and common shingles that are sent to the tasks, at most.
SAMPLE, COMMON = 20_000, 50_000


def shingles(text: bytes) -> np.ndarray:
    """The set of shingles as sorted numbers."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64)).view(np.int64)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that several texts of a sample hold, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            found = [shingles(t) for t in raw_texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["shingle"])

    chosen = docs.where(F.col("_row") <= min(-(1 << 63) + (SAMPLE << 64) // max(docs.count(), 1), (1 << 63) - 1)).select(text_col).distinct()
    rows = chosen.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64)


def with_prefixes(docs: DataFrame, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, _row, node (a number for the set), the set's size, its fingerprint fp and its first shingles."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((np.sort(common), np.argsort(common)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in blocks(batches, text_col):
            nodes, sizes, prints, sketches, firsts = [], [], [], [], []
            for t in raw_texts(batch, text_col):
                s = shingles(t)
                n = len(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(n)
                prints.append(bits_over_half(s.view(np.uint64)))
                sketches.append(np.packbits((np.bincount(s & 511, minlength=512) & 1).astype(np.uint8)).view(np.int64))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    late = known[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(rank[at[late]])]])
                firsts.append(s[: n - (4 * n + 4) // 5 + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_row"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), *map(pa.array, np.array(sketches).T.copy()), lists], names=[id_col, "_row", "node", "size", "fp", *SKETCH, "firsts"])

    return docs.select(id_col, "_row", text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, _row long, node long, size int, fp long, {', '.join(f'{k} long' for k in SKETCH)}, firsts array<long>")


def may_match(size: np.ndarray, pos: np.ndarray, size2: np.ndarray, pos2: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle has these places may share 4/9 of both sizes' sum, which is a Jaccard index of 0.8."""
    return (5 * np.minimum(size, size2) >= 4 * np.maximum(size, size2)) & (9 * np.minimum(size - pos, size2 - pos2) >= 4 * (size + size2))


def alike(size: np.ndarray, fp: np.ndarray, size2: np.ndarray, fp2: np.ndarray) -> np.ndarray:
    """Whether fingerprints lie within the radius, or a set is too small for them to tell."""
    return (np.bitwise_count((fp ^ fp2).view(np.uint64)) <= RADIUS) | (np.minimum(size, size2) < SURE)


def tree_pairs(size: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (later, earlier) of a group's sets within the radius, by a BK-tree; small sets meet all."""
    values = fp.view(np.uint64).tolist()
    tree, later, earlier = BKTree(), [], []
    small = np.flatnonzero(size < SURE).tolist()
    for i, v in enumerate(values):
        found = set(range(i)) if size[i] < SURE else {*tree.within(v, RADIUS), *(k for k in small if k < i)}
        later += [i] * len(found)
        earlier += found
        tree.add(v)
    return np.array(later, np.int64), np.array(earlier, np.int64)


def neighbours(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: for each of many fingerprints the three nearest among those next to it in eight orders, each order led by other bits."""
    f, a, b = fp.view(np.uint64), [], []
    for turn in range(0, 64, 8):
        order = np.argsort(f << np.uint64(turn) | f >> np.uint64(64 - turn) if turn else f, kind="stable")
        for step in (1, 2, 3):
            a += [order[:-step], order[step:]]
            b += [order[step:], order[:-step]]
    a, b = np.concatenate(a), np.concatenate(b)
    bits = np.bitwise_count(f[a] ^ f[b])
    order = np.lexsort((b, bits, a))
    a, b, bits = a[order], b[order], bits[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b, bits = a[fresh], b[fresh], bits[fresh]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    keep = (nth < 3) & (bits <= RADIUS)
    return a[keep], b[keep]


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns in stretches that end with a group of equal first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(n).to_numpy().astype(np.int64) for n in names]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        if len(cols[0]) and held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(cuts):
            yield [np.concatenate(x) for x in zip(*held, [c[: cuts[-1]] for c in cols], strict=True)]
            held = [[c[cuts[-1] :] for c in cols]]
        elif len(cols[0]):
            held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    return starts, np.append(starts[1:], len(key))


def meetings(dealt: DataFrame, crowd: int) -> DataFrame:
    """Pairs (u, v) to compare: all of groups up to crowd; of others one partner for each set, and the group's shingle as crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, pos, node, fp in whole_groups(batches, ["shingle", "size", "pos", "node", "fp"]):
            starts, ends = bounds(key)
            u, v, big = [], [], []
            for a, b in zip(starts[ends - starts > crowd], ends[ends - starts > crowd], strict=True):
                big.append(key[a])
                i, j = neighbours(fp[a:b])
                ok = may_match(size[a + i], pos[a + i], size[a + j], pos[a + j])
                i, j = a + np.maximum(i, j)[ok], a + np.minimum(i, j)[ok]
                u.append(node[i])
                v.append(node[j])
                while a < b:  # sizes ascend
                    end = a + int(np.searchsorted(size[a:b], size[a] * 5 // 4, side="right"))
                    i = np.arange(a + 1, end)
                    i = i[may_match(size[i], pos[i], size[a], pos[a]) & alike(size[i], fp[i], size[a], fp[a])]
                    u.append(node[i])
                    v.append(np.full(len(i), node[a]))
                    a = end
            for a, b in zip(starts, ends, strict=True):
                if FEW < b - a <= crowd:
                    i, j = tree_pairs(size[a:b], fp[a:b])
                    ok = may_match(size[a + i], pos[a + i], size[a + j], pos[a + j])
                    u.append(node[a + i[ok]])
                    v.append(node[a + j[ok]])
            small = np.repeat(ends - starts, ends - starts) <= min(FEW, crowd)
            key, size, pos, node, fp = key[small], size[small], pos[small], node[small], fp[small]
            for d in range(1, FEW):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                i = i[may_match(size[i], pos[i], size[i + d], pos[i + d]) & alike(size[i], fp[i], size[i + d], fp[i + d])]
                u.append(node[i + d])
                v.append(node[i])
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1) if u else np.empty((2, 0), np.int64)
            n, m = pairs.shape[1], len(big)
            if n + m:
                yield pa.RecordBatch.from_arrays([pa.array([*pairs[0], *[0] * m], pa.int64()), pa.array([*pairs[1], *[0] * m], pa.int64()), pa.array([*[None] * n, *big], pa.int64())], names=["u", "v", "crowded"])

    return whole(dealt, "shingle").sortWithinPartitions("shingle", "size", "pos", "node").mapInArrow(run, "u long, v long, crowded long")


def strangers(dealt: DataFrame) -> DataFrame:
    """Pairs (u, v) of different roots in a group that may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, pos, node, fp, root, *cells in whole_groups(batches, ["shingle", "size", "pos", "node", "fp", "root", *SKETCH]):
            cells = np.stack(cells, 1).view(np.uint64)
            for a, b in zip(*bounds(key), strict=True):
                s, p, x, f, r, c = size[a:b], pos[a:b], node[a:b], fp[a:b], root[a:b], cells[a:b]
                names, n = np.unique(r, return_counts=True)
                for i in np.flatnonzero(r != names[np.argmax(n)]):
                    j = np.flatnonzero((r != r[i]) & may_match(s, p, s[i], p[i]) & alike(s, f, s[i], f[i]))
                    j = j[9 * np.bitwise_count(c[j] ^ c[i]).sum(1, dtype=np.int64) <= s[j] + s[i]]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x[j], x[i])), pa.array(np.minimum(x[j], x[i]))], names=["u", "v"])

    return whole(dealt, "shingle").sortWithinPartitions("shingle", "size", "pos", "node").mapInArrow(run, "u long, v long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, prints: DataFrame, text_col: str) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard index of 0.8 or more."""
    pairs = written(pairs, "likely")
    rows = prints.groupBy("node").agg(F.min("_row").alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            found = [shingles(t) for t in raw_texts(batch, text_col)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "set"])

    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(rows, "node")
    texts = docs.select("_row", text_col).join(needed, "_row").select("node", text_col).dropDuplicates(["node"])
    sets = written(texts.mapInArrow(run, "node long, set array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    out = written(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "confirmed")
    release(pairs, sets)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Of each component of near copies the row with the smallest id, all columns as they are."""
    keyed = docs.withColumn("_row", row_key(id_col, text_col))
    prints = written(with_prefixes(keyed, common_shingles(keyed, text_col), id_col, text_col), "prefixes")
    dealt = prints.select("node", "size", "fp", "firsts").dropDuplicates(["node"]).select("node", "size", "fp", F.posexplode("firsts").alias("pos", "shingle"))
    met = written(meetings(dealt, crowd), "meetings")
    links = confirmed(met.where("crowded is null").select("u", "v").distinct(), keyed, prints, text_col)
    roots = components(links)
    release(links)
    crowded = met.where("crowded is not null").select(F.col("crowded").alias("shingle")).distinct()
    if crowded.take(1):
        sketched = prints.dropDuplicates(["node"]).select("node", "size", "fp", *SKETCH, F.posexplode("firsts").alias("pos", "shingle"))
        apart = sketched.join(crowded, "shingle").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = written(strangers(apart), "strangers")
        if more.take(1):
            found = confirmed(more, keyed, prints, text_col)
            # The new links join whole components, so only these are joined further.
            of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            between = found.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
            higher = components(between)
            both = roots.unionByName(higher.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
            joined = written(both.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            release(found, higher, roots)
            roots = joined
        release(more)
    named = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = written(named.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_row")).alias("first")).select("first._row"), "kept-rows")
    release(prints, met, roots)
    return keyed.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
