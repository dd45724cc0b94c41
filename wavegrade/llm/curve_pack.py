"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector, projected to DIMS numbers and placed on a Hilbert
curve. The documents are dealt into as many ranges of the curve as the session has shuffle partitions (bounds
from a sample of the places; documents at one point are told apart by a hash, so copies never share a range by
force), and each range lays its documents end to end in curve order. A range starts where the ranges before it
end, so the pieces, cut at multiples of the sequence length, form one gapless stream: only the last sequence is
not full. What the driver holds, bounds and sizes, has an entry for each range.

Edge cases: null and empty texts are one token, the closing one; a text longer than a sequence is cut into
several pieces; repeated rows are packed each; an empty table gives an empty one; a null id stays null; only
the id and text columns are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavegrade.llm.bpe_count import CACHED_BYTES, Rules, TwoGenerations, byte_symbols
from wavegrade.llm.common import WIDE_BYTES, blocks, raw_texts, sums, written

LENGTH, CLOSE = 4096, 2
HASHED, DIMS, BITS, TIE_BITS = 4096, 3, 10, 20
#: Rows that are sampled for each range of the curve to find its bounds.
SAMPLED = 50


#: Words and chunks that a worker keeps the ids of, in each of two generations. A word that is new costs some six microseconds, one that is known
#: a tenth of a microsecond; an entry takes some 200 bytes.
CACHED_WORDS, CACHED_CHUNKS = 250_000, 300_000
#: ASCII marks that end a word; a run of them is a word of its own.
TAIL = b".,;:!?"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(Rules):
    """Token ids of texts. White-space chunks are looked up, then their words; only a new word reaches the library's model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only wait for it
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.by_word, self.by_chunk = self.library.model, TwoGenerations(CACHED_WORDS), TwoGenerations(CACHED_CHUNKS)
        self.symbols = dict(enumerate(byte_symbols()))

    def word(self, word: str) -> bytes:
        found = self.by_word.young.get(word) or self.by_word.get(word)
        if found is None:
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
            found = pack_ids([t.id for t in self.model.tokenize(shown)])
            if len(word) <= CACHED_BYTES:
                self.by_word.put(word, found)
        return found

    def chunk(self, chunk: bytes) -> bytes:
        """The ids of a text without white space that ASCII has. A chunk whose word is new is not kept: many come once, and would push out those that come again."""
        found = self.by_chunk.get(chunk)
        if found is not None:
            return found
        core, new = chunk.rstrip(TAIL), False
        if core.isalpha():
            word = core.lower().decode()
            found = self.by_word.young.get(word) or self.by_word.get(word)
            if found is None:
                found, new = self.word(word), True
            if len(core) < len(chunk):
                found += self.word(chunk[len(core) :].decode())
        elif b"<|" in chunk:  # special strings
            found = pack_ids(self.library.encode(chunk.decode(), add_special_tokens=False).ids)
        else:
            found = b"".join(map(self.word, self.words(chunk.decode())))
        if not new and len(chunk) <= CACHED_BYTES:
            self.by_chunk.put(chunk, found)
        return found

    def encode(self, text: bytes, close: int) -> bytes:
        chunks = text.split()
        out = list(map(self.by_chunk.young.get, chunks))
        if None in out:
            out = [self.chunk(c) if ids is None else ids for c, ids in zip(chunks, out, strict=True)]
        out.append(close.to_bytes(4, "little"))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def projection() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(HASHED, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of `bits` bits each, any number of dimensions."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, highest bit first
        for i in range(n):
            on = (x[i] & q).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed vector of token counts, brought to unit length."""
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    slot = (flat * 2654435761 >> 7) % HASHED
    doc = np.repeat(np.arange(len(ids)), np.diff(starts))
    cell, count = np.unique(doc * HASHED + slot, return_counts=True)
    norm = np.sqrt(np.bincount(cell // HASHED, count.astype(float) ** 2, len(ids)))
    at = np.concatenate(([0], np.cumsum(np.bincount(cell // HASHED, minlength=len(ids)))))
    p = projection()
    where = np.column_stack([sums(p[cell % HASHED, k] * count, at) for k in range(DIMS)]) / np.maximum(norm, 1)[:, None]
    return hilbert(((np.tanh(where / 2) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))


def encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, close: int) -> DataFrame:
    """The id, place (curve key, then a hash that tells copies apart), n (tokens) and ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in blocks(batches, text_col, WIDE_BYTES):
            ids = [encode(x, close) for x in raw_texts(batch, text_col)]
            key = curve_keys([np.frombuffer(x, "<u4") for x in ids])
            place = key << TIE_BITS | batch.column("_tie").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(place), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "place", "n", "ids"])

    tie = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.monotonically_increasing_id()), F.lit(1 << TIE_BITS))
    return docs.select(id_col, text_col, tie.alias("_tie")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, place long, n long, ids binary")


def bounds(tokens: DataFrame, ranges: int) -> list[float]:
    """Places that part the tokens into about equal ranges, from a sample of SAMPLED rows a range; they only decide how even the tasks are."""
    rows = tokens.count()
    if ranges < 2 or rows < 2:
        return []
    found = tokens.select("place", "n").sample(min(1.0, SAMPLED * ranges / rows), 17).toPandas().sort_values("place")
    if found.empty:
        return []
    share = np.cumsum(found["n"].to_numpy()) / found["n"].sum()
    return sorted({float(found["place"].iloc[min(int(np.searchsorted(share, i / ranges)), len(found) - 1)]) for i in range(1, ranges)})


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, close: int = CLOSE) -> DataFrame:
    """A row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (binary)."""
    tokens = written(encoded(docs, vocabulary, id_col, text_col, close), "tokens")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = [-float("inf"), *bounds(tokens, ranges), float("inf")]
    if len(splits) > 2:
        at = tokens.withColumn("_at", F.col("place").cast("double"))
        dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_b").transform(at).withColumn("range", F.col("_b").cast("int")).drop("_at", "_b")
    else:
        dealt = tokens.withColumn("range", F.lit(0))
    sizes = np.zeros(len(splits) - 1, np.int64)
    for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).collect():  # a row for each range
        sizes[r["range"]] = r["n"]
    sent = docs.sparkSession.sparkContext.broadcast(np.concatenate(([0], np.cumsum(sizes))))
    dealt = dealt.repartitionById(len(sizes), F.col("range")).sortWithinPartitions("range", "place", id_col, "n")
    of_id = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            rows, out = [], []
            for i, (r, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "n", "ids")), strict=True)):
                if r != now:
                    now, at = r, int(sent.value[r])
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append(i)
                    out.append((start, size, zlib.crc32(piece), n, at // length, at % length, piece))
                    start, at = start + size, at + size
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return dealt.mapInArrow(run, f"`{id_col}` {of_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
