"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics are taken from the whole text in numpy, a block of documents at a time. cos(Wx + b) with Gaussian
W approximates a Gaussian kernel on the standardised statistics. Each partition of the training rows gives
its own Z'Z and Z'y; their sums give the ridge weights. Rows set aside from the fit calibrate: binned sums
of their labels, pooled until they rise, and lines between the pools.

The fit uses a bounded sample of labelled rows (SAMPLE, by hash of the id); scoring covers every row.

Edge cases: null and empty texts have all-zero counts and get a score like any other; without any label every
score is 0.5; labels that are null or repeated count once per id, the lowest; a text of any length is measured
whole; equal texts score equal; an empty table gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import WIDE_BYTES, blocks, checkpointed, flat, raw_texts, sums, windows, word_ids

#: Labelled rows that the fit takes, about.
SAMPLE = 40_000
#: Random features, and the ridge penalty per training row.
FEATURES, RIDGE = 256, 1e-4
BINS, TASKS = 400, 8

SPACE, CAPITAL, SMALL, DIGIT, SYMBOL, BANG, STOP, OTHER, HIGH, NEWLINE = range(10)


def byte_kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:] = HIGH
    for chars, k in ((b" \t\r\x0b\x0c", SPACE), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), (b"abcdefghijklmnopqrstuvwxyz", SMALL), (b"0123456789", DIGIT), (b"#*$%&|<>", SYMBOL), (b"!", BANG), (b".,;:?", STOP), (b"\n", NEWLINE)):
        kind[list(chars)] = k
    return kind


KIND = byte_kinds()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text."""
    data, at = flat(texts)
    kind = KIND[data]
    n = np.diff(at).astype(float)
    by = np.stack([sums(kind == k, at) for k in range(10)], 1).astype(float)
    gap = (kind == SPACE) | (kind == NEWLINE)
    first = ~gap
    first[1:] &= gap[:-1]
    if len(data):
        inner = at[(at > 0) & (at < len(data))]
        first[inner] = ~gap[inner]
    begin = np.flatnonzero(first)
    ids, starts = word_ids(texts, defaultdict(count().__next__))
    words = np.diff(starts)
    w = np.maximum(words, 1).astype(float)
    size = sums(~gap, np.append(begin, len(data))) if len(begin) else np.zeros(0)
    size = np.minimum(size, 64).astype(float)
    text = np.repeat(np.arange(len(texts)), words)
    mean = sums(size, starts) / w
    spread = np.sqrt(np.maximum(sums(size * size, starts) / w - mean * mean, 0))
    distinct = np.bincount(np.unique(text * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1), minlength=len(texts)) if len(ids) else np.zeros(len(texts))
    place, rank = windows(ids, starts, 2)
    owner = text[place] if len(place) else np.zeros(0, np.int64)
    top = int(rank.max()) + 1 if len(rank) else 1
    pairs = np.bincount(np.unique(owner * top + rank) // top, minlength=len(texts)) if len(rank) else np.zeros(len(texts))
    echo = np.zeros(len(ids), bool)
    echo[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    heads = kind[begin] if len(begin) else np.zeros(0, np.uint8)
    per_word = lambda x: sums(x, starts) / w
    share = by / np.maximum(n, 1)[:, None]
    return np.column_stack([
        np.log1p(n), np.log1p(words), mean, spread, share, distinct / w, np.minimum(pairs, w) / w, per_word(echo),
        per_word(size <= 2), per_word(size >= 12), per_word(heads == CAPITAL), per_word(heads == SYMBOL), per_word((heads == SYMBOL) & (size == 1)),
        np.log1p(by[:, NEWLINE]), np.log1p(w / (by[:, NEWLINE] + 1)), np.log1p(by[:, STOP] / w), np.log1p(by[:, BANG] / w),
    ])


class Model:
    """mean, scale: of the statistics; w, b: the random features; beta: ridge weights; x, y: the calibration's corners."""

    def __init__(self, mean=None, scale=None, w=None, b=None):
        self.mean, self.scale, self.w, self.b, self.beta, self.x, self.y = mean, scale, w, b, None, None, None

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / self.w.shape[1]) * np.cos(np.clip((rows - self.mean) / self.scale, -8, 8) @ self.w + self.b)
        return np.column_stack([z, np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.beta

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(rows), 0.5)
        raw = self.raw(rows)
        return np.clip(0.98 * np.interp(raw, self.x, self.y) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def pooled(good: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins: the pools' centres and their rising label means."""
    pools: list[list[float]] = []
    for g, m, c in zip(good, n, x, strict=True):
        pools.append([g, m, c * m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and x, the array of statistics."""
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, WIDE_BYTES):
            rows = statistics(raw_texts(batch, text_col))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=[*keep, "x"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, calibrate: Column | None = None) -> Model:
    """A model of P(label = 1). Of the labelled rows a sample of about `sample` is used; calibrate says which of them calibrate."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("_y"))
    total = known.count()
    if not total:
        return Model()
    # A threshold on the whole 64-bit hash, so that the share never rounds to nothing.
    chosen = known.where(F.xxhash64(F.lit("fit"), id_col) <= min(-(1 << 63) + (sample << 64) // total, (1 << 63) - 1))
    aside = calibrate if calibrate is not None else F.pmod(F.xxhash64(F.lit("calibrate"), id_col), F.lit(4)) == 0
    # The chosen labels are bounded by `sample`, so this side may be sent to every task.
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col("_y"), aside.alias("_aside"), F.col(text_col).alias("_text"))
    rows = checkpointed(measured(rows, ["_y", "_aside"], "_text").repartition(TASKS))
    of = F.posexplode("x").alias("i", "v")
    moments = rows.select(of).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n")).orderBy("i").collect()
    if not moments:
        return Model()
    rng, mean = np.random.default_rng(7), np.array([r["m"] for r in moments])
    scale = np.maximum([r["s"] or 0.0 for r in moments], 1e-6)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    d = FEATURES + 1

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            z, y = model.features(matrix(batch)), batch.column("_y").to_numpy()
            a, c, n = a + z.T @ z, c + z.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([a, c]).tobytes()]), pa.array([n], pa.int64())], names=["sums", "n"])

    def sums_of(part: DataFrame) -> tuple[np.ndarray, int]:
        got = part.mapInArrow(gram, "sums binary, n long").collect()  # TASKS rows at most
        return sum((np.frombuffer(r["sums"]).reshape(d, d + 1) for r in got), np.zeros((d, d + 1))), sum(r["n"] for r in got)

    equations, n = sums_of(rows.where("not _aside"))
    if not n:
        equations, n = sums_of(rows)
    model.beta = np.linalg.solve(equations[:, :d] + RIDGE * n * np.diag([1.0] * FEATURES + [1e-6]), equations[:, d])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(np.clip(model.raw(matrix(batch)), -0.5, 1.5))], names=["y", "raw"])

    held = rows.where("_aside") if rows.where("_aside").take(1) else rows
    bins = held.mapInArrow(scored, "y double, raw double").groupBy(F.floor(F.col("raw") * (BINS / 2)).alias("bin")).agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.avg("raw").alias("x")).orderBy("bin").collect()
    model.x, model.y = pooled(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float), np.array([r["x"] for r in bins]))
    return model


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns in keep with score and predicted."""
    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, WIDE_BYTES):
            s = model.score(statistics(raw_texts(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score of threshold or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, WIDE_BYTES):
            yield batch.filter(pa.array(model.score(statistics(raw_texts(batch, text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
