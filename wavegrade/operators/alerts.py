"""Counters on a calendar of minutes: increase, rate, held and absent, as functions on DataFrames.

Samples: label columns (keys), a time in seconds, a counter that starts anew now and then. Steps between samples of one minute
are taken inside that minute, those between minutes on one summary a minute, so that a series of any size is never one task's rows.
A value below the one before it is a restart and counts whole; a series' first value counts nothing. Samples of one second go by the
columns of order. Rows without time or value are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _step(value, last):
    return F.when(last.isNull(), 0).when(value < last, value).otherwise(value - last)


def minutes(samples: DataFrame, keys: list[str], time: str = "at_s", value: str = "value", order: tuple[str, ...] = ()) -> DataFrame:
    """A row for each series and minute with samples: how many, and by how much the counter rose in it, the step that leads into it included."""
    place = [time, *order, value]
    s = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).withColumn("minute", F.floor(F.col(time) / 60))
    inner = s.withColumn("_step", _step(F.col(value), F.lag(value).over(Window.partitionBy(*keys, "minute").orderBy(*place))))
    at = F.struct(*place)
    one = inner.groupBy(*keys, "minute").agg(F.count("*").alias("n"), F.sum("_step").alias("_inner"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    edge = _step(F.col("_first"), F.lag("_last").over(Window.partitionBy(*keys).orderBy("minute")))
    return one.select(*keys, "minute", "n", (F.col("_inner") + edge).alias("rise"))


def increase(samples: DataFrame, keys: list[str], window: int = 5, fallback: int | None = None, until: int | None = None, **named) -> DataFrame:
    """At each minute the increase over the last window minutes. Minutes whose window has no sample are left out, or get
    fallback, from the series' first minute to until (its last one when None)."""
    m = minutes(samples, keys, **named)
    seen = m.select(*keys, F.explode(F.sequence(F.col("minute"), F.col("minute") + window - 1)).alias("minute"), "rise").groupBy(*keys, "minute").agg(F.sum("rise").alias("increase"))
    span = m.groupBy(*keys).agg(F.min("minute").alias("_from"), F.max("minute").alias("_to"))
    if until is not None:
        span = span.withColumn("_to", F.greatest("_to", F.lit(until)))
    if fallback is None:
        return seen.join(span, keys).where("minute <= _to").select(*keys, "minute", "increase")
    grid = span.select(*keys, F.explode(F.sequence("_from", "_to")).alias("minute"))
    return grid.join(seen, [*keys, "minute"], "left").select(*keys, "minute", F.coalesce("increase", F.lit(fallback)).alias("increase"))


def rate(samples: DataFrame, keys: list[str], by: list[str], window: int = 5, **named) -> DataFrame:
    """The increase a second over the last window minutes, series summed by the labels of by."""
    return increase(samples, keys, window, **named).groupBy(*by, "minute").agg((F.sum("increase") / F.lit(60 * window)).alias("rate"))


def held(increases: DataFrame, keys: list[str], minutes_held: int) -> DataFrame:
    """Stretches of minutes in a row with an increase, that last minutes_held minutes after their first one; since, until, and
    fires, the minute at which the alert does."""
    up = increases.where("increase > 0").withColumn("_run", F.col("minute") - F.row_number().over(Window.partitionBy(*keys).orderBy("minute")))
    runs = up.groupBy(*keys, "_run").agg(F.min("minute").alias("since"), F.max("minute").alias("until"))
    return runs.where(F.col("until") - F.col("since") >= minutes_held).select(*keys, "since", "until", (F.col("since") + minutes_held).alias("fires"))


def absent(samples: DataFrame, keys: list[str], window: int = 30, minutes_held: int = 5, until: int | None = None, **named) -> DataFrame:
    """Stretches of minutes whose last window minutes have no sample of the series, after its first one and up to until; fires is
    null where the stretch ends before it has lasted minutes_held minutes. By the gaps between minutes: no calendar is built."""
    m = minutes(samples, keys, **named).select(*keys, "minute")
    after = F.lead("minute").over(Window.partitionBy(*keys).orderBy("minute"))
    last = F.coalesce(after - 1, F.lit(until)) if until is not None else after - 1
    gaps = m.select(*keys, (F.col("minute") + window).alias("since"), last.alias("until")).where("since <= until")
    return gaps.withColumn("fires", F.when(F.col("until") - F.col("since") >= minutes_held, F.col("since") + minutes_held))
