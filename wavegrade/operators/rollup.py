"""Rollups of latency distributions that shards report as they grow, as functions on DataFrames.

A partial row is what one shard knows at a second of a wave: session_id, wave, shard, second_ns, the distribution since the
wave began as a map from bucket to count (cum), and counters of that second alone. A silent shard has no row. Windows are
keyed by shard and wave, so they hold as many rows as a wave has seconds; sums over shards are plain aggregates.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAVE, SHARD = ["session_id", "wave"], ["session_id", "wave", "shard"]
EMPTY = "map<bigint,bigint>"


def plus(a: Column, b: Column) -> Column:
    """Bucket-wise sum of two distributions."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, n: s + n)


def quantile(m: Column, q: str) -> Column:
    """A03 on a map: the first bucket by which max(1, ceil(q * total)) values are seen, 0 for an empty distribution."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(Decimal(q)) * total(m)))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit"))

    def step(s, e):
        seen = s["seen"] + e["value"]
        return F.struct(seen.alias("seen"), F.coalesce(s["hit"], F.when(seen >= need, e["key"])).alias("hit"))

    return F.coalesce(F.aggregate(F.array_sort(F.map_entries(m)), start, step)["hit"], F.lit(0))


def partials(counts: DataFrame, counters: list[str], run: str = "run") -> DataFrame:
    """What shards report, from counts by (shard, run, second, bucket_hi, n): cum grows over a run of the shard's process and begins
    anew with the next run; counters are summed by second."""
    seconds = counts.groupBy(*SHARD, run, "second_ns").agg(F.map_from_entries(F.collect_list(F.struct("bucket_hi", F.col("n").cast("long")))).alias("slice"), *(F.sum(c).alias(c) for c in counters))
    so_far = F.collect_list("slice").over(Window.partitionBy(*SHARD, run).orderBy("second_ns").rowsBetween(Window.unboundedPreceding, 0))
    return seconds.select(*SHARD, "second_ns", F.aggregate(so_far, F.create_map().cast(EMPTY), plus).alias("cum"), *counters)


def slices(partial: DataFrame) -> DataFrame:
    """The distribution of each second alone: cum less the shard's last one, bucket by bucket. A shard's first one is whole, and so
    is one that lacks values of the last (its process began anew)."""
    last = F.lag("cum").over(Window.partitionBy(*SHARD).orderBy("second_ns"))
    found = partial.withColumn("_last", F.coalesce(last, F.create_map().cast(EMPTY)))
    less = F.map_zip_with("cum", "_last", lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    anew = F.exists(F.map_values("_less"), lambda n: n < 0)
    return found.withColumn("_less", less).withColumn("slice", F.when(anew, F.col("cum")).otherwise(F.map_filter("_less", lambda k, n: n > 0))).drop("_last", "_less")


def carried(partial: DataFrame) -> DataFrame:
    """A row for each shard and second at which any shard of the wave reported, from the shard's first on, with its last
    distribution; fresh tells whether it reported then."""
    grid = partial.groupBy(*SHARD).agg(F.min("second_ns").alias("_first")).join(partial.select(*WAVE, "second_ns").distinct(), WAVE).where("second_ns >= _first")
    known = grid.join(partial.select(*SHARD, "second_ns", "cum"), [*SHARD, "second_ns"], "left")
    held = F.last("cum", ignorenulls=True).over(Window.partitionBy(*SHARD).orderBy("second_ns").rowsBetween(Window.unboundedPreceding, 0))
    return known.select(*SHARD, "second_ns", held.alias("cum"), F.col("cum").isNotNull().alias("fresh"))


def merged(rows: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """A04 on maps: the distributions of col added up by keys; pre-aggregated by bucket, so that no task holds a group's maps."""
    sums = rows.select(*keys, F.explode(col).alias("_bucket", "_n")).groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "_n"))).alias(col))


def rolled(partial: DataFrame, counters: list[str], quantiles: dict[str, str]) -> DataFrame:
    """A row for each second of a wave at which a shard reported: quantiles of that second's values over all shards, the sums of
    its counters, and the distribution since the wave began (cum), silent shards with their last one."""
    at, partial = [*WAVE, "second_ns"], partial.repartition(*WAVE)  # all groups and windows lie inside a wave: dealt once, they need no shuffle of their own
    whole = merged(carried(partial), "cum", at)
    own = merged(slices(partial), "slice", at)
    sums = partial.groupBy(*at).agg(*(F.sum(c).alias(c) for c in counters))
    rows = sums.join(whole, at).join(own, at, "left").withColumn("slice", F.coalesce("slice", F.create_map().cast(EMPTY)))
    return rows.select(*at, *counters, *(quantile(F.col("slice"), q).alias(name) for name, q in quantiles.items()), "cum")
