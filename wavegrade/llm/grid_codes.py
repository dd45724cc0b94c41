"""Vector code compression: parts of vectors as numbers of codebook entries, found through memoised grid cells.

A part lies in a cell of a coarse grid. For a cell, every entry has a least and a greatest distance to the cell's
box; an entry whose least distance is over another's greatest one can't be nearest to anything inside (equal ones
stay, so ties are kept). A task hashes the cell of each part, remembers the entries that are left for it, and
evaluates only those exactly. Two cells with one hash are told apart, and the later one is evaluated in full.
Spark adds the tasks' sums of the entries; entries x part lengths numbers a part reach the driver each round.

Edge cases: vectors that are null or hold nulls, NaN or infinities are left out, and so are those whose length isn't
that of the kept vector with the smallest id, or isn't divisible by the number of parts; ties go to the lower index;
unused entries stay; fewer vectors than entries make as many entries as there are vectors, and none an empty table;
repeated rows count as often as they occur, rows with one id become entries in the order of their vectors, null ids
last; null labels are one label; only the id, vector and label columns are read.
Numbers of any size up to vectors.GREATEST are exact; a distance or sum over 63 bits is given as the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import written
from wavegrade.llm.vectors import SUMS, finite, is_wide, long_sum, matrix, means, numbers, saturated, scaled, sums_of

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one step takes, cells that a task remembers of a part before it begins anew, and so many tasks share a label's join.
STEP, CELLS, SALTS = 4096, 1 << 15, 16


class Grid:
    """The entries that are left in each cell met so far, of one part's codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = max(int(book.max() - book.min()), 1) if book.size else 1
        self.edge = 1 << max(spread.bit_length() - 2, 0)  # two to four cells across what the entries span
        self.known: dict[int, tuple[bytes, np.ndarray]] = {}
        self.asked = self.met = self.evaluated = 0

    def left(self, cells: np.ndarray) -> np.ndarray:
        """Which entries can be nearest in each cell (rows of cell numbers)."""
        low = (cells * self.edge)[:, None, :]
        high = low + (self.edge - 1)
        near = (np.maximum(np.maximum(low - self.book, self.book - high), 0) ** 2).sum(2)
        far = (np.maximum(abs(low - self.book), abs(high - self.book)) ** 2).sum(2)
        return near <= far.min(1)[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry and its squared distance."""
        cells = parts // self.edge
        narrow = np.ascontiguousarray((cells % (1 << 62)).astype(np.int64)) if cells.dtype == object else np.ascontiguousarray(cells)
        code = np.zeros(len(parts), np.uint64)
        for d in range(parts.shape[1]):
            code = (code ^ narrow[:, d].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
        codes, first, place = np.unique(code, return_index=True, return_inverse=True)
        if len(self.known) > CELLS:
            self.known.clear()
        new = np.array([c not in self.known for c in codes.tolist()], bool)
        if new.any():
            for c, cell, entries in zip(codes[new].tolist(), cells[first[new]], self.left(cells[first[new]]), strict=True):
                self.known[c] = (cell, entries)
        self.asked, self.met = self.asked + len(codes), self.met + int((~new).sum())
        remembered = [self.known[c] for c in codes.tolist()]
        choice = np.stack([r[1] for r in remembered])[place]
        choice[(np.stack([r[0] for r in remembered])[place] != cells).any(1)] = True
        row, entry = np.nonzero(choice)
        self.evaluated += len(row)
        distance = ((parts[row] - self.book[entry]) ** 2).sum(1)
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, begins)
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]], least


def _steps(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Books: parts x entries x part length. Of each step: its rows, their parts (parts first), and each part's nearest entries and distances."""
    grids = [Grid(b) for b in books]
    n_parts, _, width = books.shape
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            pieces = matrix(part, n_parts * width).reshape(-1, n_parts, width).swapaxes(0, 1)
            yield part, pieces, [g.nearest(np.ascontiguousarray(p)) for g, p in zip(grids, pieces, strict=True)]


def _partial_sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    n_parts, n_entries, width = books.shape
    for _, pieces, found in _steps(batches, books):
        place = np.concatenate([p * n_entries + f[0] for p, f in enumerate(found)])
        yield sums_of(place, pieces.reshape(-1, width), n_parts * n_entries)


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, _, found in _steps(batches, books):
        codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
        error = sum(f[1] for f in found)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(saturated(error), pa.int64())], names=["vec_id", "label", "code", "error"])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error and codebooks_sha256. At most 256 entries."""
    usable = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")) & (F.size("v") % parts == 0))
    smallest = usable.groupBy("i").agg(F.min(F.size("v")).alias("n")).orderBy(F.col("i").asc_nulls_last()).limit(1).collect()
    length = smallest[0].n if smallest else parts
    table = scaled(vectors, {"vec_id": id_col, "label": label_col}, vector_col, scale, length)
    seeds = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not seeds:
        return table.select("vec_id", F.lit(None).cast("string").alias("code"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error")), F.lit(None).cast("string").alias("codebooks_sha256"))
    books = numbers([r.v for r in seeds], is_wide(table)).reshape(len(seeds), parts, length // parts).swapaxes(0, 1)
    for _ in range(rounds):
        flat = books.reshape(-1, length // parts)
        books = means(table.mapInArrow(partial(_partial_sums, books=books), SUMS), flat).reshape(books.shape)
    types = {c: table.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = written(table.mapInArrow(partial(_coded, books=books), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    # Each label's sum meets its rows in SALTS places, so that a label with a large share of them is no single task.
    by_label = coded.groupBy(F.col("label").alias("l")).agg(long_sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("of", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(by_label, F.col("label").eqNullSafe(F.col("l")) & (F.col("of") == F.col("salt"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
