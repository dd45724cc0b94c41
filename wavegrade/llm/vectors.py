"""What the two operators on embeddings share: components as whole numbers, and exact sums over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import written

#: Below this size of a number, squared distances of up to 256 components and their differences fit into 64 bits; from there on Python's whole numbers are used.
NARROW = 1 << 26
#: Beyond this size sums of many rows do not fit into 38 digits.
GREATEST = 10**28
LONG_MAX = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def scaled(vectors: DataFrame, cols: dict[str, str], vector_col: str, scale: int, length: int) -> DataFrame:
    """A written table with the columns cols (new name: old name) and v, the floors of scale times the components of all vectors of the given length."""
    named = vectors.select(*(F.col(old).alias(new) for new, old in cols.items()), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")) & (F.size("v") == length))
    top = named.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    if top * scale >= GREATEST:
        raise ValueError(f"a component of {top:g} is over {GREATEST / scale:g}, from where sums are not exact")
    kind = "long" if top * scale < NARROW and length <= 256 else "decimal(38,0)"
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in cols) + f", v array<{kind}>"
    return written(named.mapInArrow(partial(_floors, scale=scale, wide=kind != "long"), schema), "vectors")


def _floors(batches: Iterator[pa.RecordBatch], scale: int, wide: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("v")
        floors = np.floor(values.flatten().to_numpy() * scale)
        flat = pa.array([int(x) for x in floors], pa.decimal128(38, 0)) if wide else pa.array(floors.astype(np.int64))
        sizes = values.value_lengths().to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(c) if c != "v" else pa.ListArray.from_arrays(offsets, flat) for c in batch.schema.names], names=batch.schema.names)


def matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The vectors of a batch as rows: 64-bit numbers, or Python's where they are wide."""
    flat = batch.column("v").flatten()
    if pa.types.is_decimal(flat.type):
        return np.array([int(x) for x in flat.to_pylist()], object).reshape(-1, length)
    return flat.to_numpy(zero_copy_only=False).reshape(-1, length)


def numbers(rows: list, wide: bool) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in rows], object if wide else np.int64)


def is_wide(table: DataFrame) -> bool:
    return table.schema["v"].dataType.elementType.typeName() == "decimal"


def saturated(values: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what doesn't fit is the greatest one."""
    return values if values.dtype != object else np.array([min(int(x), LONG_MAX) for x in values], np.int64)


def long_sum(col: str) -> Column:
    """An exact sum as a long; what doesn't fit is the greatest one."""
    return F.least(F.sum(F.col(col).cast("decimal(19,0)")), F.lit(LONG_MAX).cast("decimal(29,0)")).cast("long")


SUMS = "place int, s decimal(38,0), n long"


def sums_of(place: np.ndarray, values: np.ndarray, places: int) -> pa.RecordBatch:
    """One task's rows of SUMS: for each place the componentwise sums of its values, at places * position + place, and their number."""
    total = np.zeros((places, values.shape[1]), values.dtype)
    np.add.at(total, place, values)
    n = np.bincount(place, minlength=places)
    used = np.flatnonzero(n)
    at = (np.arange(values.shape[1])[:, None] * places + used).ravel()
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([int(x) for x in total[used].T.ravel()], pa.decimal128(38, 0)), pa.array(np.tile(n[used], values.shape[1]), pa.int64())], names=["place", "s", "n"])


def means(partial_sums: DataFrame, old: np.ndarray) -> np.ndarray:
    """old (places x positions) with the floored means of all places that have values; Spark adds the tasks' sums, and only places x positions rows reach the driver."""
    new = old.copy()
    for r in partial_sums.groupBy("place").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect():
        new[r.place % len(old), r.place // len(old)] = int(r.s) // r.n
    return new
