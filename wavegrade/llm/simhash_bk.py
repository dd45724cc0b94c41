"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked within a radius by BK-trees.

A fingerprint is made of a text's whole word sequence (ASCII lower case, words without ASCII white space).
Two fingerprints within radius R agree on at least B - R of B blocks of bits, so every choice of B - R
blocks deals the distinct fingerprints into small groups, and a linked pair meets in one of them. A group's
fingerprints grow one BK-tree, whose children are keyed by their Hamming distance to the parent; a query
follows only edges within the radius. Trees are built where the shuffle puts their group instead of being
broadcast, as all fingerprints together grow with the corpus. Equal fingerprints enter once; a group gives
at most one link per fingerprint (its local forest), and large-star/small-star rounds join the links.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other; under three
words the whole sequence is the only shingle; repeated rows each get a row; ties of bits (exactly half) are
0; a null id gets a row but names no component unless nothing else does; an empty table gives an empty one;
only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, release, whole, written

RADIUS, BLOCKS, SEED = 2, 4, 42


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    """XXH64 of each shingle of width words, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    begins, at = [], 0
    for w in words:
        begins.append(at)
        at += len(w) + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begins, [x - 1 for x in begins[width:]] + [len(joined)], strict=False)]


_weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def bits_over_half(hashes: np.ndarray) -> np.uint64:
    """The fingerprint: each bit that is set in over half of the hashes; zero without any."""
    h, ones = hashes.astype(">u8"), np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return _weights[2 * ones > len(h)].sum(dtype=np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    return np.array([bits_over_half(np.array(shingle_hashes(t), np.uint64)) for t in texts], np.uint64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and fp, the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            fp = fingerprints(raw_texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values, self.children = [], []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            for k in range(d - radius, d + radius + 1):
                if k in edges:
                    todo.append(edges[k])
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, smallest value of its local component) among distinct values."""
    tree, up = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def links(distinct: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) that connect all distinct fp within radius of one another; n_blocks over radius."""
    if n_blocks <= radius or 64 % n_blocks:
        raise ValueError("n_blocks must divide 64 and be more than radius")
    width = 64 // n_blocks
    masks = []
    for chosen in combinations(range(n_blocks), n_blocks - radius):
        mask = sum(((1 << width) - 1) << (width * k) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)))).alias("key")).select("fp", "key.choice", "key.part")
    # Fingerprints that are alone in their group need no tree; counting them is a partial aggregate.
    crowded = dealt.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1").select("choice", "part")
    dealt = whole(dealt.join(crowded, ["choice", "part"]), "choice", "part").sortWithinPartitions("choice", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(values: list[int]) -> pa.RecordBatch:
            got = forest([v & (1 << 64) - 1 for v in values], radius)
            u, v = (np.array([x[k] for x in got], np.uint64).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        key, group = None, []
        for batch in batches:
            for c, p, fp in zip(*(batch.column(k).to_pylist() for k in ("choice", "part", "fp")), strict=True):
                if (c, p) != key:
                    if len(group) > 1:
                        yield out(group)
                    key, group = (c, p), []
                group.append(fp)
        if len(group) > 1:
            yield out(group)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root), a written table, for every node of the links (u, v): alternating large-star and small-star rounds until nothing moves."""
    edges = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(small, "edges")
        # Rows are distinct on both sides, so equal tables have equal counts and sums of row hashes.
        same = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for t in (nxt, edges)]
        release(edges)
        edges = nxt
        if same[0] == same[1]:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = written(roots, "roots")
    release(edges)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    prints = written(with_fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(firsts.select("fp"), radius))
    named = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp", "left").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
