"""Sinks for foreachBatch whose effect is the same however often Spark gives a batch: after a failure between a write and the
checkpoint the batch comes again with its number.

A table is Parquet by partition columns. A sink reads the partitions that a batch touches, merges, writes the result to a shared folder
and puts it in their place (dynamic partition overwrite), so that work follows what changed and not the table. Merges by key give the
same rows a second time; appended rows lie in a partition of their batch's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrade.sources import io

Sink = Callable[[DataFrame, int], None]


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under path, which is made empty if it isn't there."""
    none = spark.createDataFrame([], schema)
    none.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).select(*none.columns)  # Spark reads partition columns last


def put(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Rows in the place of the partitions that they lie in."""
    io.stored(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def merging(path: str, schema: str, partitions: list[str], merge: Callable[[DataFrame, DataFrame, int], DataFrame]) -> Sink:
    """A sink that puts merge(old rows of touched partitions, batch, batch number) in their place. A partition's rows never leave it: keys hold its columns."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        old = table(batch.sparkSession, path, schema).join(batch.select(*partitions).distinct(), partitions, "left_semi")
        put(merge(old, batch, batch_id), path, partitions)
        batch.unpersist()

    return sink


def upserting(path: str, schema: str, partitions: list[str], keys: list[str], order: list[str] | None = None) -> Sink:
    """Of each key the batch's last row by order takes the place of the old one."""
    return merging(path, schema, partitions, lambda old, new, _: io.upsert(old, new.select(*old.columns), keys, order))


def inserting(path: str, schema: str, partitions: list[str], key: str) -> Sink:
    """Rows whose key is not there yet."""
    return merging(path, schema, partitions, lambda old, new, _: old.unionByName(io.insert_absent(old, new.select(*old.columns), key)))


def claiming(path: str, schema: str, partitions: list[str], key: str = "session_id") -> Sink:
    """A key's first row stays, but for a timed_out one that a scored one replaces. claimed_by is the number of the batch whose row won: that
    batch publishes it, also when it comes again; schema has it last."""

    def merge(old: DataFrame, new: DataFrame, batch_id: int) -> DataFrame:
        cols = [c for c in old.columns if c != "claimed_by"]
        won = io.claim_upsert(old.select(*cols), new.select(*cols), key)
        before = old.select(F.col(key).alias("_key"), "claimed_by")
        return won.join(before, F.col(key) == F.col("_key"), "left").select(*cols, F.when(F.col("claimed"), batch_id).otherwise(F.col("claimed_by")).cast("long").alias("claimed_by"))

    return merging(path, schema, partitions, merge)


def appending(path: str, schema: str) -> Sink:
    """Rows as they come, under their batch's number (column batch_id, last in schema)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        table(batch.sparkSession, path, schema)
        put(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])

    return sink


def rerolling(history_path: str, history_schema: str, metrics_path: str, metrics_schema: str, keys: list[str], sums: list[str]) -> Sink:
    """Rows go to the history under their batch's number, and the sums of the keys that they touch are computed anew from all of it."""
    append = appending(history_path, history_schema)
    store = upserting(metrics_path, metrics_schema, keys[:1], keys)

    def sink(batch: DataFrame, batch_id: int) -> None:
        append(batch, batch_id)
        history = table(batch.sparkSession, history_path, history_schema)
        again = history.join(batch.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        store(again, batch_id)

    return sink


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """All input there is, batch by batch; a checkpoint that is there already is gone on from."""
    stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
