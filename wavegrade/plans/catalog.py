"""Named queries as DataFrames, and as one SQL statement each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavegrade.operators import derived, feeds, grading, relational, served
from wavegrade.sources import io, views

QUERIES = relational.QUERIES | grading.QUERIES
VIEWS = views.VIEWS | grading.VIEWS | derived.VIEWS | served.VIEWS

#: Views that are written once for a statement: their columns are costly, and a filter or join on one would compute it again, and each reader all of them.
WRITTEN = ("messages",)

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def named(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


def statement(sql: str, views: dict[str, str] = VIEWS) -> str:
    """The query with the views it needs in front, each after those that it builds on."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in named(text, views):
            if n not in needed:
                visit(views[n])
                needed.append(n)

    visit(sql)
    head = ",\n".join(f"{n} as ({views[n].strip()})" for n in needed)
    return f"with {head}\n{sql}" if head else sql


SHUFFLES, SPLITS, _rows = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", {}
#: Bytes of a file that a task reads at most: some half a million rows of lineitem. A task that aggregates what it reads holds all of it.
SPLIT_BYTES = 8 << 20


def dealt(spark: SparkSession, tables: dict[str, DataFrame], sf_dir: str) -> None:
    """The session's shuffle partitions, raised so that a task of a shuffle takes about io.TASK_ROWS rows of the greatest table; smaller tables later get the session's own number again."""
    for t, df in tables.items():
        if (sf_dir, t) not in _rows:
            _rows[sf_dir, t] = io.tasks_for(df)
    set_here, own = (spark.conf.get(f"wavegrade.{k}", None) for k in ("shuffles", "own"))
    now = spark.conf.get(SHUFFLES)
    own = own if now == set_here else now
    n = str(max(int(own), 2 * max((_rows[sf_dir, t] for t in tables), default=1)))
    if n != now:
        spark.conf.set(SHUFFLES, n)
    size, unit = re.match(r"(\d+) *([kmgt]?)", spark.conf.get(SPLITS).lower()).groups()
    if int(size) << 10 * " kmgt".index(unit or " ") > SPLIT_BYTES:
        spark.conf.set(SPLITS, str(SPLIT_BYTES))
    spark.conf.set("wavegrade.shuffles", n)
    spark.conf.set("wavegrade.own", own)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, QUERIES[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the views and tables."""
    sql = statement(sql, {n: v for n, v in VIEWS.items() if n not in WRITTEN})
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named(sql, TABLES)}
    dealt(spark, tables, sf_dir)
    tables |= {n: io.stored(run(spark, sf_dir, VIEWS[n])) for n in named(sql, WRITTEN)}
    for t in tables:
        sql = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    return spark.sql(sql, **tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: frame(spark, sf_dir, name) for name in QUERIES} | feeds.QUERIES


def oracle_sql() -> dict[str, str]:
    views = VIEWS | grading.ORACLE_VIEWS | derived.ORACLE_VIEWS
    return {name: statement(grading.ORACLES.get(name, sql), views) for name, sql in QUERIES.items()} | {name: statement(sql, views) for name, sql in feeds.ORACLES.items()}
