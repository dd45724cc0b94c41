"""Benchmark decontamination by an FM-index of each training shard.

A shard is a block of documents in a task. Its words become integers by the benchmark's vocabulary; stretches
in which some neighbouring two words are no pair of any window can't hold a window and are left out of the
index, exactly. The rest is sorted into a suffix array, whose Burrows-Wheeler transform sits in a wavelet
matrix. All windows are searched backwards at once by ranks; the rows found are walked to the next sampled
suffix position, and the spans they cover are merged per document.

The benchmark is the only broadcast. Its items are cut into stretches of STRETCH words that overlap by a
window less one word, so that each window lies in one; stretches are dealt into parts of about PART_WORDS
words, and only one part is sent at a time. With several parts each one's hits go to a written table, and the
spans and items of a document are merged from all of them, so the result does not depend on the parts.

Edge cases: null, empty and word-less texts have no words and no hits; items without a word have no window;
items of fewer than 13 words are one window; repeated items each count by their id, items with a null id
count in hits but not among the ids; very long texts make a shard of their own; repeated rows are judged each;
an empty benchmark or table gives zero hits or no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, written

WIDTH, SAMPLE = 13, 8
#: Words of a benchmark that are sent at a time, about (their windows and index take some 200 bytes a word in each task), and of a stretch of an item.
PART_WORDS, STRETCH = 2_000_000, 4096


def word_table() -> bytes:
    """A byte map: ASCII capitals to small letters, all other ASCII but digits and letters to a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        out[b] = ord(c) if c.isalnum() else 32
    return bytes(out)


_WORDS = word_table()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            cum, z = self.ones[k], self.zeros[k]
            start = np.where(one, z + cum[start], start - cum[start])
            at = np.where(one, z + cum[at], at - cum[at])
        return at - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling; seq ends in a symbol below all others."""
    rank, have, n = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1, len(seq)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - have] = rank[have:] + 1
        order = np.argsort(rank * (n + 2) + nxt, kind="stable")
        both = (rank * (n + 2) + nxt)[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(both[1:] != both[:-1])))
        rank, have = new, have * 2
        if rank[order[-1]] == n - 1:
            return order
        if have >= n:
            raise AssertionError("suffixes must differ")


class FMIndex:
    """seq: integers over 0, without the closing 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        top = int(seq.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.matrix = WaveletMatrix(self.bwt, max(1, top.bit_length()))
        self.top = top
        marked = (sa % sample == 0) | (sa == 0)
        self.marked, self.place = marked, np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; patterns are right-aligned rows, padded on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step]
            known = c <= self.top
            c = np.where(known, c, 0)
            low[live] = np.where(known, self.before[c] + self.matrix.rank(c, low[live]), 0)
            high[live] = np.where(known, self.before[c] + self.matrix.rank(c, high[live]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, live = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.marked[rows[live]]]):
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.matrix.rank(c, rows[live])
            steps[live] += 1
        return self.samples[self.place[rows]] + steps


class Benchmark:
    """Distinct windows as right-aligned integers, the items of each, and the words and word pairs in them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int = WIDTH):
        self.ids = {}  # word -> integer from 2 on; 1 stands between stretches
        found: dict[tuple, set] = {}
        for item, words in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 2) for w in words]
            for i in range(max(1, len(seq) - width + 1)):
                if seq:
                    found.setdefault(tuple(seq[i : i + width]), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for r, w in enumerate(found):
            self.patterns[r, width - len(w) :] = w
        self.items = [sorted(str(x) for x in v if x is not None) for v in found.values()]
        self.base = len(self.ids) + 2
        a, b = self.patterns[:, :-1].ravel(), self.patterns[:, 1:].ravel()
        self.pairs = np.unique((a * self.base + b)[a > 0])
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def stretches(self, seq: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which words lie in a run of window pairs as long as the shortest window."""
        known = seq > 1
        if not len(seq):
            return known
        key = seq[:-1] * self.base + seq[1:]
        at = np.searchsorted(self.pairs, key)
        tied = known[:-1] & known[1:] & (doc[1:] == doc[:-1])
        tied &= (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key) if len(self.pairs) else False
        run = np.concatenate(([0], np.cumsum(~tied)))
        return known & (np.bincount(run)[run] >= self.shortest)

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: how many words, the merged spans of hit words [a, b), and the items found."""
        ids, get = [], self.ids.get
        starts = [0]
        for t in texts:
            ids.extend([get(w, 0) for w in words_of(t)])
            starts.append(len(ids))
        seq, starts = np.array(ids, np.int64), np.array(starts, np.int64)
        n_words = np.diff(starts)
        spans, items = [[] for _ in texts], [set() for _ in texts]
        doc = np.repeat(np.arange(len(texts)), n_words)
        place = np.flatnonzero(self.stretches(seq, doc)) if len(self.lengths) else np.zeros(0, np.int64)
        if not len(place):
            return n_words, spans, items
        broken = np.concatenate(([False], (np.diff(place) > 1) | (doc[place][1:] != doc[place][:-1])))
        shift = np.arange(len(place)) + np.cumsum(broken)
        text = np.ones(int(shift[-1]) + 1, np.int64)
        origin = np.zeros(len(text), np.int64)
        text[shift], origin[shift] = seq[place], place
        index = FMIndex(text)
        low, high = index.search(self.patterns, self.lengths)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        begin = origin[index.locate(rows)]
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + self.lengths[which], -1)
        hit = np.cumsum(edge)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            while a < b:  # a run of hits may pass over the end of a text
                d = int(doc[a])
                end = min(b, int(starts[d + 1]))
                spans[d].append((a - int(starts[d]), end - int(starts[d])))
                a = end
        for key in np.unique(doc[begin] * len(self.items) + which).tolist():
            items[key // len(self.items)].update(self.items[key % len(self.items)])
        return n_words, spans, items


def stretches(benchmark: DataFrame, id_col: str, text_col: str, size: int = STRETCH) -> DataFrame:
    """(item, n, words): the items' words in runs of size that overlap by a window less one word, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            item, n, words = [], [], []
            for row, (i, text) in enumerate(zip(batch.column(id_col).cast(pa.string()).to_pylist(), raw_texts(batch, text_col), strict=True)):
                w = words_of(text)
                for k in range(0, max(1, len(w) - WIDTH + 1), size) if w else ():
                    part = w[k : k + size + WIDTH - 1]
                    item.append(i)
                    n.append(len(part))
                    words.append(b" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int64()), pa.array(words, pa.binary())], names=["item", "n", "words"])

    return benchmark.select(id_col, text_col).mapInArrow(run, "item string, n long, words binary")


def parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Benchmark]:
    """The benchmark's windows, a part of about limit words at a time; one empty part if there are no words."""
    rows = stretches(benchmark, id_col, text_col)
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = -(-total // limit) or 1
    if n > 1:
        rows = written(rows.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(n)).cast("int")), "benchmark")
    for k in range(n):
        own = rows.where(F.col("part") == k) if n > 1 else rows
        yield Benchmark([(r["item"], bytes(r["words"]).split()) for r in own.select("item", "words").toLocalIterator()])


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def spread(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{a}:{b}" for a, b in spans)


def merged(found: list[str]) -> list[tuple[int, int]]:
    """The union of spans given as start:end lists; neighbours that touch stay apart only where no part joins them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(tuple(map(int, s.split(":"))) for x in found for s in x.split(",") if s):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def results(ids: pa.Array, id_col: str, n_words: list[int], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> pa.RecordBatch:
    n_hit = [sum(b - a for a, b in s) for s in spans]
    return pa.RecordBatch.from_pydict({
        id_col: ids, "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
        "contaminated": pa.array([is_contaminated(n, h) for n, h in zip(n_words, n_hit, strict=True)], pa.bool_()),
        "spans": pa.array([spread(s) for s in spans], pa.string()),
    })


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that differ in id or text; equal rows have equal results."""
    return F.concat_ws(":", F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Per row: the id, n_words, n_hit, n_items, items_sha256, contaminated, and spans, the merged hit word spans as start:end."""
    spark, of_id = docs.sparkSession, dict(docs.dtypes)[id_col]
    todo = parts(benchmark, item_col, item_text_col, part_words)
    first = next(todo)
    second = next(todo, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, text_col):
                n_words, spans, items = sent.value.hits(raw_texts(batch, text_col))
                yield results(batch.column(id_col), id_col, n_words.tolist(), spans, items)

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {of_id}, {RESULT}")
    keyed = docs.select(row_key(id_col, text_col).alias("_key"), id_col, text_col)
    hits = None
    for part in chain((first, second), todo):
        sent = spark.sparkContext.broadcast(part)
        found = written(keyed.select("_key", text_col).mapInArrow(hit_rows(sent, text_col), "_key string, spans string, items array<string>"), "hits")
        sent.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("_key").agg(F.collect_set("spans").alias("_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))  # parts x 1 at most for each document

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x or []) for x in batch.column("_spans").to_pylist()]
            yield results(batch.column(id_col), id_col, batch.column("_n").to_pylist(), spans, [set(x or []) for x in batch.column("_items").to_pylist()])

    counted = keyed.mapInArrow(word_counts(id_col, text_col), f"_key string, `{id_col}` {of_id}, _n long")
    return counted.join(hits, "_key", "left").select(id_col, "_n", "_spans", "_items").mapInArrow(merge, f"`{id_col}` {of_id}, {RESULT}")


def hit_rows(sent, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            _, spans, items = sent.value.hits(raw_texts(batch, text_col))
            hit = [i for i, s in enumerate(spans) if s]
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(hit, pa.int64())), pa.array([spread(spans[i]) for i in hit], pa.string()), pa.array([sorted(items[i]) for i in hit], pa.list_(pa.string()))], names=["_key", "spans", "items"])

    return run


def word_counts(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column(id_col), pa.array([len(words_of(t)) for t in raw_texts(batch, text_col)], pa.int64())], names=["_key", id_col, "_n"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are; rows equal in id and text are judged alike, a null text or id like any other."""
    todo = parts(benchmark, "item_id", "text", part_words)
    first = next(todo)
    second = next(todo, None)
    if second is not None:
        keyed = docs.withColumn("_doc_key", row_key(id_col, text_col))
        bad = find_contamination(keyed.select("_doc_key", text_col).dropDuplicates(["_doc_key"]), benchmark, "_doc_key", text_col, part_words=part_words).where("contaminated")
        return keyed.join(bad.select("_doc_key"), "_doc_key", "left_anti").drop("_doc_key")
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            got = list(zip(*sent.value.hits(raw_texts(batch, text_col)), strict=True))
            yield batch.filter(pa.array([not is_contaminated(x[0], sum(b - a for a, b in x[1])) for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
