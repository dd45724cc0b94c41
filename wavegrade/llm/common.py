"""Helpers that the training-data operators share: shared-folder tables, Arrow blocks, word rules."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python task holds at a time.
BLOCK_BYTES = 4 << 20
#: The same for steps whose arrays take many times their text.
WIDE_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a local one serves local sessions; any other session gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = "/tmp/spark-shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, removed by release or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing still to be computed reads."""
    for t in tables:
        remove(t.sparkSession, t._written)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer; a stopped session leaves it to the cluster's cleaner."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def whole(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys so that each task has whole groups. By a hash of the keys, not the keys themselves: after a join on
    them Spark would leave the exchange out and may then split a large partition of the join, and its groups with it."""
    return df.repartition(F.xxhash64(*keys))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string").cast("binary")), F.lit(parts))


def folded(doc_id: str, parts: int) -> Column:
    return F.coalesce(fold(doc_id, parts), F.lit(0))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about limit bytes of text; a longer single text makes a run of its own. After the last the task's free memory is handed back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    batch = None
    hand_back()


def hand_back() -> None:
    """Give back to the system what Arrow and the C library keep of freed memory. A worker outlives its task, and what it keeps counts against its executor in all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim is not None:
        trim(0)


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """Each row's text as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text begins (one more entry than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring starts, empty runs being 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def record(schema: str | pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def word_ids(texts: list[bytes], words: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, equal for equal words, and where each text's words begin (one more entry than texts)."""
    known = words if words is not None else defaultdict(count().__next__)
    ids, starts = [], [0]
    for text in texts:
        ids.extend(map(known.__getitem__, text.split()))
        starts.append(len(ids))
    return np.array(ids, np.int64), np.array(starts, np.int64)


def windows(ids: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of width words begins that lies inside one text, and a number for it, equal for equal runs. width: a power of two."""
    rank, have = ids, 1
    while have < width:
        if len(rank) <= have:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = rank[:-have] * (int(rank.max()) + 1) + rank[have:]
        rank, have = np.unique(both, return_inverse=True)[1], 2 * have
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = text[: len(rank)] == text[width - 1 :][: len(rank)]
    return np.flatnonzero(whole), rank[whole]
