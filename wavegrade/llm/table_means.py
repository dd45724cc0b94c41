"""Centroid clustering with scalar lookup tables.

Components are whole numbers, so a squared difference depends on few values: each round every task tabulates it
for each dimension, each value that occurs there and each centroid, and a vector's distances are gathers from the
tables and their sums. Spark adds the tasks' sums of the clusters; centroids x dimensions numbers reach the driver
and go to the tasks again, whatever the number of vectors.

Edge cases: vectors that are null, of another length, or hold nulls, NaN or infinities are left out; ties go to the
smaller number; empty centroids stay; fewer vectors than centroids make as many centroids as there are vectors, and
none an empty table; repeated rows count as often as they occur, and rows with one id are drawn as seeds in the
order of their vectors; a null id is an empty text when seeds are drawn; only the id and vector columns are read.
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
from wavegrade.llm.vectors import SUMS, is_wide, long_sum, matrix, means, numbers, saturated, scaled, sums_of

CENTROIDS, ROUNDS, LENGTH, SCALE, SALT = 8, 10, 64, 1024, "3:"
#: Rows that one step tabulates, and the widest range of values that is looked up without a search.
STEP, RANGE = 8192, 1 << 16


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and each value's place among them."""
    low = values.min()
    if values.dtype == object or values.max() - low >= RANGE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(int(values.max() - low) + 1, bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and its squared distance."""
    distance = np.zeros((len(vectors), len(centroids)), vectors.dtype)
    for d in range(vectors.shape[1]):
        values, place = occurring(vectors[:, d])
        table = (values[:, None] - centroids[:, d]) ** 2
        distance += table[place]
    nearest = np.argmin(distance, axis=1)
    return nearest, distance[np.arange(len(vectors)), nearest]


def _steps(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            yield part, matrix(part, length)


def _partial_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, vectors in _steps(batches, centroids.shape[1]):
        yield sums_of(assign(vectors, centroids)[0], vectors, len(centroids))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, vectors in _steps(batches, centroids.shape[1]):
        nearest, distance = assign(vectors, centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(saturated(distance), pa.int64())], names=["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    table = scaled(vectors, {"vec_id": id_col}, vector_col, scale, length)
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = table.orderBy(drawn, "v").limit(k).collect()
    id_type = table.schema["vec_id"].dataType.simpleString()
    if not seeds:
        return table.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = numbers([r.v for r in seeds], is_wide(table))
    for _ in range(rounds):
        centroids = means(table.mapInArrow(partial(_partial_sums, centroids=centroids), SUMS), centroids)
    assigned = written(table.mapInArrow(partial(_assigned, centroids=centroids), f"vec_id {id_type}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(long_sum("distance").alias("total")).collect()}
    by_cluster = [(c, F.lit(inertia.get(c, 0)).cast("long"), F.lit(hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest())) for c in range(len(centroids))]
    pick = lambda i: F.element_at(F.array(*(row[i] for row in by_cluster)), F.col("cluster") + 1)
    return assigned.select("vec_id", "cluster", "distance", pick(1).alias("cluster_inertia"), F.lit(min(sum(inertia.values()), (1 << 63) - 1)).cast("long").alias("inertia"), pick(2).alias("centroid_sha256"))
