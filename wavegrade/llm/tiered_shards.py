"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of a like size (a tier is a power of FANOUT
times the smallest size) are merged when a tier holds FANOUT or more: whole files are packed into runs whose
bytes sum to at most the target, and each run becomes one new file, read and written by one task without a
shuffle. Every change writes new files, then commits a new manifest version: the manifest is written whole under
a name of its own, then given its version's name, which must not exist yet. Readers take the newest version and
its files only, so a lost executor, a failed merge or a writer that stops at any point leaves nothing half done.
A version's file that no writer of this store can have left (empty or cut off) is passed over by its number.
vacuum removes files that no kept version names, once they are older than a grace time. Where a file system has
no rename or link that fails on an existing name (some object stores), writers must be kept apart otherwise.

Edge cases: null ids and texts and repeated rows are kept as they are; one row larger than the target makes
a shard of its own; an empty table commits a manifest without shards; columns of any name pass unchanged; of
two writers that commit the same version one wins, and the other gets an error and may start again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrade.llm.common import shared_folder

TARGET_BYTES, ARRIVAL_ROWS, FANOUT, SMALLEST = 128 << 20, 20_000, 4, 1 << 20
#: Arrivals in which a table is put into a store.
ARRIVALS = 8
#: Runs that one job merges.
MERGED_AT_ONCE = 64


class ShardStore:
    """Shards and manifests under one folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root, target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{root}/manifests"))

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> list[dict] | None:
        """The shards of a version; None if its file is not whole."""
        text = self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).first()
        return json.loads(text[0]) if text and text[0].endswith("\n") else None

    def manifest(self) -> tuple[int, list[dict]]:
        """The newest version and its shards: path, bytes and tier."""
        for version in reversed(self.versions()):
            shards = self._manifest(version)
            if shards is not None:
                return version, shards
        return 0, []

    def _publish(self, written, final) -> None:
        """Give a whole file its final name, unless that exists: a hard link on local files, elsewhere a rename that does not overwrite."""
        jvm = self.spark.sparkContext._jvm
        if self._fs.getUri().getScheme() == "file":
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, written)]
            jvm.java.nio.file.Files.createLink(*paths)
            self._fs.delete(written, False)
            return
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(written, final, options)

    def commit(self, seen: int, shards: list[dict]) -> int:
        """Write the version after seen; fails if somebody else has. Numbers after seen whose files are not whole are passed over."""
        text = json.dumps(sorted(shards, key=lambda s: s["path"])).encode() + b"\n"
        written = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}.tmp")
        out = self._fs.create(written, False)
        out.write(text)
        out.close()
        later = [v for v in self.versions() if v > seen]
        if any(self._manifest(v) is not None for v in later):
            self._fs.delete(written, False)
            raise RuntimeError(f"a version after {seen} was committed meanwhile")
        version = max([seen, *later]) + 1
        try:
            self._publish(written, self._path(f"{self.root}/manifests/v{version:08d}.json"))
        except Py4JJavaError as error:
            if "exist" in str(error.java_exception).lower():
                raise RuntimeError(f"version {version} was committed meanwhile") from error
            raise
        return version

    def tier(self, size: int) -> int:
        t = 0
        while size > SMALLEST * FANOUT**t:
            t += 1
        return t

    def _files(self, folder: str) -> list[dict]:
        out = []
        for x in self._fs.listStatus(self._path(folder)):
            if x.getPath().getName().endswith(".parquet"):
                out.append({"path": x.getPath().toString(), "bytes": x.getLen(), "tier": self.tier(x.getLen())})
        return out

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(folder)
        return self._files(folder)

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        seen, shards = self.manifest()
        return self.commit(seen, shards + self._write(df, rows))

    def append_arrivals(self, df: DataFrame, arrivals: int, id_col: str, rows: int = ARRIVAL_ROWS):
        """df as so many arrivals, dealt by the id and written in one pass; each is committed as a version of its own when its turn comes."""
        folder, name = f"{self.root}/shards/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        dealt = df.withColumn(name, F.pmod(F.xxhash64(id_col), F.lit(arrivals)))
        dealt.write.partitionBy(name).option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(folder)
        for k in range(arrivals):
            if self._fs.exists(self._path(f"{folder}/{name}={k}")):
                seen, shards = self.manifest()
                yield self.commit(seen, shards + self._files(f"{folder}/{name}={k}"))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """The shards packed into runs of at most the target's bytes, the largest first into the first run with room."""
        out: list[list] = []
        for s in sorted(shards, key=lambda s: (-s["bytes"], s["path"])):
            room = next((r for r in out if r[0] + s["bytes"] <= self.target), None)
            if room is None:
                out.append([s["bytes"], s])
            else:
                room[0] += s["bytes"]
                room.append(s)
        return [r[1:] for r in out]

    def compact(self, schema) -> int:
        """One merge over all tiers that hold FANOUT shards or more; the version after it, or the same one if none does."""
        seen, shards = self.manifest()
        small = [s for s in shards if 2 * s["bytes"] <= self.target]
        tiers = Counter(s["tier"] for s in small)
        merge = [r for t in sorted(tiers) if tiers[t] >= FANOUT for r in self.runs([s for s in small if s["tier"] == t]) if len(r) > 1]
        if not merge:
            return seen
        made = []
        for k in range(0, len(merge), MERGED_AT_ONCE):
            each = [self.spark.read.schema(schema).parquet(*(s["path"] for s in r)).coalesce(1) for r in merge[k : k + MERGED_AT_ONCE]]
            made += self._write(reduce(DataFrame.unionAll, each))
        gone = {s["path"] for r in merge for s in r}
        return self.commit(seen, [s for s in shards if s["path"] not in gone] + made)

    def vacuum(self, keep: int = 1, grace_s: float = 86_400) -> int:
        """Remove shard files that none of the newest `keep` versions names and that are older than the grace time (a commit may be under way); how many went."""
        named, kept = set(), 0
        for version in reversed(self.versions()):
            shards = self._manifest(version) if kept < keep else None
            if shards is not None:
                named |= {s["path"] for s in shards}
                kept += 1
        gone = 0
        for top, end in (("shards", ".parquet"), ("manifests", ".tmp")):
            files = self._fs.listFiles(self._path(f"{self.root}/{top}"), True) if self._fs.exists(self._path(f"{self.root}/{top}")) else None
            while files is not None and files.hasNext():
                x = files.next()
                old = x.getModificationTime() / 1000 <= time.time() - grace_s
                if x.getPath().getName().endswith(end) and x.getPath().toString() not in named and old:
                    gone += bool(self._fs.delete(x.getPath(), False))
        return gone

    def read(self, schema) -> DataFrame:
        shards = self.manifest()[1]
        return self.spark.read.schema(schema).parquet(*(s["path"] for s in shards)) if shards else self.spark.createDataFrame([], schema)


def shard(docs: DataFrame, target: int = TARGET_BYTES, root: str | None = None, arrivals: int = ARRIVALS, id_col: str = "doc_id") -> tuple[ShardStore, int]:
    """docs put into a store in several arrivals, after each of which tiers that are crowded are merged; the store and its version."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", target)
    version = 0
    for version in store.append_arrivals(docs, arrivals, id_col):
        while (new := store.compact(docs.schema)) != version:
            version = new
    return store, version or store.manifest()[0] or store.commit(0, [])


def placed(docs: DataFrame, id_col: str = "doc_id", target: int = TARGET_BYTES) -> DataFrame:
    """Per row: the id, the shard's number in the manifest, the shard's bytes, and the manifest version."""
    store, version = shard(docs, target, id_col=id_col)
    spark, files = docs.sparkSession, store.manifest()[1]
    # One row per shard of the target size: a file list, which Spark's reader holds in the driver as well.
    names = spark.createDataFrame([(s["path"].rsplit("/", 1)[-1], i, s["bytes"]) for i, s in enumerate(files)], "name string, shard_id long, shard_bytes long")
    rows = store.read(docs.schema).select(id_col, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    return rows.join(names, "name").select(id_col, "shard_id", "shard_bytes", F.lit(version).cast("long").alias("version"))
