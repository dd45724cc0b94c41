"""Sources and sinks: event batches, JSON events, upserts, snapshots and exports, as functions on DataFrames.

Readers take a DataFrame that spark.read or spark.readStream gives, so each works on both. Upserts return the
new content of their target; the caller writes it beside the old one and swaps, as Parquet has no merge.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegrade import schemas

SECOND_NS = 1_000_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share; local sessions may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return f"{found or '/tmp/spark-shared'}/feeds-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options) -> DataFrame:
    """df as a table in a new shared folder, read again: its rows and partitions stay what they are."""
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest(source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the last by order, ties by all columns; rows that are equal in both are one."""
    cols = [c for c in source.columns if c not in keys]
    last = F.max_by(F.struct(*cols), F.struct(*(order or []), *(c for c in cols if c not in (order or [])))) if cols else None
    return source.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*").select(*source.columns) if cols else source.distinct()


def read_sent(batches: DataFrame) -> DataFrame:
    """A row for each event of the batches, with the envelope's fields."""
    return batches.select("session_id", "contestant_id", "barrier_epoch_ns", F.inline("events"))


def read_acked(batches: DataFrame) -> DataFrame:
    """A row for each event of the batches, with the envelope's fields."""
    return batches.select("session_id", "contestant_id", F.inline("events"))


#: A query that runs once gives its shuffles' files back when it ends; else they lie there until the driver's next collection of garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which then get their values of before again."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows that a task takes at most, about: its memory then doesn't grow with the input.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame, least: int = 1, most: int | None = None) -> int:
    """How many tasks (or batches of most rows) these rows are to be dealt to, by their number."""
    return max(least, -(-rows.count() // (most or TASK_ROWS)))


def told_in_order(spark: SparkSession, path: str) -> bool:
    """Gives the files of a written table times in the order of their partitions, which is the order in which a stream takes them.
    False where a file system keeps no such times: files may then come in any order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    start = system.getFileStatus(files[0]).getModificationTime() // 1000 * 1000 - 1000 * len(files)
    for i, file in enumerate(files):  # whole seconds: some file systems keep no finer ones
        system.setTimes(file, start + 1000 * i, -1)
    return all(system.getFileStatus(file).getModificationTime() == start + 1000 * i for i, file in enumerate(files))


def to_batches(events: DataFrame, envelope: list[str], size: int = 1000, deals: int | None = None) -> DataFrame:
    """The events as batches of at most size, by envelope: what S01 and S02 read. An envelope's events are dealt by a hash of them, so that no
    task numbers all of them; each deal may leave one batch that is not full."""
    fields = [c for c in events.columns if c not in envelope]
    dealt = events.withColumn("_deal", F.pmod(F.xxhash64(*fields), F.lit(deals or tasks_for(events))))
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*envelope, "_deal").orderBy(*fields[:1])) - 1)
    return numbered.groupBy(*envelope, "_deal", F.floor(F.col("_n") / size).alias("_batch")).agg(F.collect_list(F.struct(*fields)).alias("events")).drop("_deal", "_batch")


def decoded(values: DataFrame, schema: str, value_col: str = "value") -> DataFrame:
    """JSON events as columns; what can't be read has null columns."""
    return values.select(F.from_json(value_col, schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")


def session_meta(values: DataFrame) -> DataFrame:
    """The newest assignment of each session: its band and whether all its tasks run at full rate."""
    e = decoded(values, schemas.ASSIGNMENT).where("session_id is not null")
    full = (F.size("tasks") > 0) & F.forall("tasks", lambda t: t["target_rps"] == 0)
    return e.groupBy("session_id").agg(F.max_by("band", "at_ns").alias("band"), F.max_by(full, "at_ns").alias("max_rate"))


def scan_session(events: DataFrame, session_id: str, started_ns: int, end_ns: int, time_col: str = "t0", lead_ns: int = 60 * SECOND_NS) -> DataFrame:
    """One session's events from lead_ns before it started up to the newest at the start of the scan; both reach the files as filters."""
    return events.where((F.col("session_id") == session_id) & (F.col(time_col) >= started_ns - lead_ns) & (F.col(time_col) <= end_ns))


def session_start_ms(session_id: str) -> int | None:
    """The time inside a session id of version 7, in milliseconds; None for any other id."""
    digits = session_id.replace("-", "")
    if not re.fullmatch(r"[0-9a-fA-F]{32}", digits) or digits[12] != "7":
        return None
    return int(digits[:12], 16) or None


def write_events(rows: DataFrame, path: str, partitions: int, time_col: str = "t0", key: str = "order_id") -> None:
    """Events in folders by the hour of their time and by partition of their key, appended; a folder much greater than others is dealt to several tasks."""
    placed = rows.withColumn("event_hour", F.floor(F.col(time_col) / (3600 * SECOND_NS)).cast("int")).withColumn("part", shard(F.col(key), partitions).cast("int"))
    placed.hint("rebalance", "event_hour", "part").write.mode("append").partitionBy("event_hour", "part").parquet(path)


def scan_layout(spark: SparkSession, path: str, session_id: str, end_ns: int, partitions: int, band: int | None = None, width: int = 10, time_col: str = "t0", lead_ns: int = 60 * SECOND_NS) -> DataFrame:
    """One session's events from a layout of write_events, from lead_ns before the time in its id (from the first event for an
    id without one) up to end_ns, in the leased band of partitions (all if None). Hours and partitions choose the folders that are read."""
    start = session_start_ms(session_id)
    events = spark.read.parquet(path).where((F.col("session_id") == session_id) & (F.col(time_col) <= end_ns) & (F.col("event_hour") <= end_ns // (3600 * SECOND_NS)))
    if start is not None:
        from_ns = start * 1_000_000 - lead_ns
        events = events.where((F.col(time_col) >= from_ns) & (F.col("event_hour") >= from_ns // (3600 * SECOND_NS)))
    return events if band is None else events.where(F.col("part").isin(band_partitions(band, width, partitions)))


def band_partitions(band: int, width: int, partitions: int) -> list[int]:
    """The partitions that a leased band covers, wrapping around."""
    return sorted({(band * width + k) % partitions for k in range(min(width, partitions))})


def split_bad(values: DataFrame, schema: str, session_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): decoded events of the session (any if None), and how many were undecodable or of another session."""
    marked = values.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    broken = F.col("e._corrupt").isNotNull() | F.col("e.session_id").isNull()
    foreign = F.lit(False) if session_id is None else F.col("e.session_id") != session_id
    reason = F.when(broken, "undecodable").when(foreign, "foreign")
    good = marked.where(F.coalesce(~broken & ~foreign, F.lit(False))).select("e.*").drop("_corrupt")
    return good, marked.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def write_partial(rows: DataFrame, path: str, time_col: str = "second_ns") -> None:
    """Append rows, by hour of their event time."""
    rows.withColumn("event_hour", F.floor(F.col(time_col) / (3600 * SECOND_NS))).write.mode("append").partitionBy("event_hour").parquet(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The target's rows, those of source taking the place of rows with the same key; of several with one key the last by order."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(newest(source, keys, order))


def live_view(snapshots: DataFrame, now_ns: int, ttl_ns: int = 3600 * SECOND_NS) -> DataFrame:
    """The newest snapshot of each (contestant, session, wave) not older than the ttl, and whether the session's live pointer is at it: its highest wave."""
    fresh = snapshots.where(F.col("time_ns") >= now_ns - ttl_ns)
    rest = [c for c in snapshots.columns if c not in ("contestant_id", "session_id", "wave")]
    newest = fresh.groupBy("contestant_id", "session_id", "wave").agg(F.max_by(F.struct(*rest), "time_ns").alias("s")).select("contestant_id", "session_id", "wave", "s.*")
    return newest.withColumn("live", F.col("wave") == F.max("wave").over(Window.partitionBy("session_id")))


def claim_upsert(target: DataFrame, source: DataFrame, key: str = "session_id") -> DataFrame:
    """A row is taken if its key is new, or if the old one is timed_out and it is scored; claimed says whether this source's row won.
    Of several source rows with one key a scored one goes before others, then the greatest by its columns."""
    source = newest(source.withColumn("_scored", F.col("status") == "scored"), [key], ["_scored"]).drop("_scored")
    old = target.select(key, F.struct(*(c for c in target.columns if c != key)).alias("old"))
    new = source.select(key, F.struct(*(c for c in target.columns if c != key)).alias("new"))
    both = old.join(new, key, "full_outer")
    wins = F.col("new").isNotNull() & (F.col("old").isNull() | ((F.col("old.status") == "timed_out") & (F.col("new.status") == "scored")))
    return both.select(key, F.when(wins, F.col("new")).otherwise(F.col("old")).alias("row"), F.coalesce(wins, F.lit(False)).alias("claimed")).select(key, "row.*", "claimed")


def fold_progress(status: DataFrame, correctness: DataFrame) -> DataFrame:
    """A row for each session with the newest of each stream's columns."""
    s = status.groupBy("session_id").agg(F.max_by("status", "at_ns").alias("status"))
    c = correctness.groupBy("session_id").agg(F.max_by(F.struct("correctness_score", "scored", "dirty"), "at_ns").alias("c")).select("session_id", "c.*")
    return s.join(c, "session_id", "full_outer")


def insert_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The rows of source whose key the target lacks, to be appended; of several with one key one."""
    return newest(source, [key]).join(target.select(key), key, "left_anti")


def to_kafka(rows: DataFrame, key: str) -> DataFrame:
    """Key and JSON value, as the Kafka sink takes them."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table scan, with the columns that are needed."""
    found = spark.read.parquet(path)
    return found.select(*columns) if columns else found


TASK_SPECS = "array<struct<task_id:long,target_rps:long>>"


def explode_tasks(scenarios: DataFrame, specs_col: str = "task_specs") -> DataFrame:
    """A row for each task of the JSON specs, with its place in the list."""
    specs = F.from_json(specs_col, TASK_SPECS)
    return scenarios.select("scenario_id", F.posexplode(specs).alias("place", "task")).select("scenario_id", "place", "task.*")


def export(tables: dict[str, DataFrame], destination: str) -> None:
    """Every table compressed in a folder of its own; Spark's _SUCCESS file marks a whole one."""
    for name, df in tables.items():
        df.write.option("compression", "gzip").parquet(f"{destination}/{name}")


def export_hgrm(curve: DataFrame, path: str) -> None:
    """Value, percentile and count, parted by blanks."""
    curve.select("value", "percentile", "total").write.option("sep", " ").csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows appended with tabs."""
    rows.write.mode("append").option("sep", "\t").csv(path)


def read_samples(rows: DataFrame) -> DataFrame:
    """Metric samples with their labels as a map."""
    return rows.select("ts", "name", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("labels"), "value")


def read_logs(rows: DataFrame) -> DataFrame:
    """Log lines with the fields of their JSON text."""
    return rows.select("ts", "service_name", F.from_json("line", schemas.LOG_LINE).alias("f")).select("ts", "service_name", "f.*")


def shard(key: Column, n: int) -> Column:
    """A shard number that other engines can compute as well."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(n))


def write_sharded(rows: DataFrame, path: str, n: int, key: str = "order_id", chunk: int = 1000, tasks: int | None = None) -> None:
    """Rows dealt to n shards by the key, in files of at most chunk rows; two streams written alike meet shard by shard. A shard with more
    rows than a task is to take is dealt to several."""
    deals = -(-(tasks or tasks_for(rows)) // n)
    placed = rows.withColumn("shard", shard(F.col(key), n))
    place = F.col("shard") * deals + F.pmod(F.xxhash64(key), F.lit(deals))
    placed.repartitionById(n * deals, place.cast("int")).write.option("maxRecordsPerFile", chunk).partitionBy("shard").parquet(path)


def write_bucketed(rows: DataFrame, n: int, keys: tuple[str, ...] = ("session_id", "order_id")) -> DataFrame:
    """S25 for joins: rows as a table of n buckets by keys, a file and a sort for each, in a new shared folder, read again. Tables with
    equal n and keys join and aggregate by these keys without a shuffle. n is to be chosen so that a bucket fits a task's memory (tasks_for)."""
    name = "bucketed_" + uuid.uuid4().hex
    rows.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", scratch(rows.sparkSession)).saveAsTable(name)
    return rows.sparkSession.table(name)


RANKS = {"uploaded": 0, "building": 1, "scanned": 2, "sbom_ready": 2, "ready": 3, "failed": 4}


def fold_submissions(events: DataFrame, key: str = "entity_id", status: str = "status", time: str = "at") -> DataFrame:
    """The status of each submission: its events in the order of time (ties by status), where a lower rank than the present one and
    anything after failed has no effect, and unknown or null statuses have none. That is the last one of the greatest rank, so any order of
    arrival gives the same and tasks pre-aggregate. ignored: how many known events came after one of greater rank."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col(status)]
    e = events.select(F.col(key).alias("_key"), F.col(status).alias("_status"), F.col(time).alias("_at"), rank.alias("_rank")).where("_rank is not null and _key is not null and _at is not null")
    over = [F.min(F.when(F.col("_rank") > r, F.struct("_at", "_status"))).alias(f"_over{r}") for r in range(4)]
    state = e.groupBy("_key").agg(F.max_by("_status", F.struct("_rank", "_at", "_status")).alias("status"), F.max_by("_at", F.struct("_rank", "_at", "_status")).alias("since"), *over)
    passed = F.coalesce(*(F.when(F.col("_rank") == r, F.col(f"_over{r}")) for r in range(4)))
    back = e.join(state.select("_key", *(f"_over{r}" for r in range(4))), "_key").where(passed < F.struct("_at", "_status")).groupBy("_key").agg(F.count("*").alias("ignored"))
    return state.join(back, "_key", "left").select(F.col("_key").alias(key), "status", "since", F.coalesce("ignored", F.lit(0)).alias("ignored"))
