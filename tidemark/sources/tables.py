"""Tables of the session catalog: replaced as a whole, overwritten by part, merged by part.

* `replace_table` writes a new table and lets the view of the published name show it, so a run may
  read what it replaces and a failed run leaves the name as it was. Tables superseded stay for `KEEP_DAYS`,
  for readers that began with them.
* `overwrite_parts` rewrites the partitions it is given and no others (dynamic partition overwrite).
* `merge_table` upserts by key and rewrites only partitions that hold a source key. A key's partition
  is derived from the key (its day, or a hash bucket), so neither side is searched for it, the target
  is read in those partitions alone, and a small source is the only side that moves.

Concurrent writers, time travel and removal of old files are left to the table format of the cluster.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import unique_on
from tidemark.sources.files import qualified

#: Partition column of merged tables, and the hash buckets of keys without a day.
PART = "part"
BUCKETS = 64
#: Days that a superseded table stays.
KEEP_DAYS = 7
#: Table property that holds what was observed while the table was written.
OBSERVED = "tidemark.observed"
#: Partition values that go into a scan's filter at once: days or buckets, never rows.
MOST_PARTS = 100_000

# Published marts, their merge keys (none: replaced) and source tables.
DATASETS = (
    ("gold_topic_hourly", ("tenant_id", "hour_ts", "topic")),
    ("gold_brand_daily", ("tenant_id", "metric_date", "brand")),
    ("gold_trend_snapshot", ()),
    ("gold_challenge_snapshot", ()),
    ("gold_executive_kpis", ()),
    ("gold_connector_operations", ()),
    ("gold_trending_topics", ()),
    ("gold_opportunities", ()),
    ("decision_recommendations", ("recommendation_id",)),
    ("decision_experiments", ("experiment_id",)),
    ("decision_learnings", ("learning_id",)),
    ("gold_experiment_performance", ()),
    ("gold_pilot_scorecard", ()),
)


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def _quoted(table: str) -> str:
    return qualified(*table.split("."))


def _versions(spark: SparkSession, table: str) -> list[str]:
    """Tables written for a published name, oldest first; their names ascend by time."""
    database, name = table.split(".")
    rows = spark.sql(f"SHOW TABLES IN {qualified(database)} LIKE '{name}__v*'").collect()
    return sorted(f"{database}.{r.tableName}" for r in rows)


def _written(version: str) -> int:
    """When a version was begun, in milliseconds."""
    return int(version.rsplit("__v", 1)[1].split("_")[0])


def replace_table(
    df: DataFrame, table: str, keep_when_empty: bool = False, metrics: dict[str, Column] | None = None
) -> dict:
    """Publish the rows of ``df`` under the name; what was observed while they were written.

    ``n``, the row count, is compared with the written files' own; ``metrics`` are further
    aggregates, taken on the way without another scan. An empty result leaves a published table in
    place if ``keep_when_empty``.
    """
    spark = df.sparkSession
    database, name = table.split(".")
    before = _versions(spark, table)
    now = max(time.time_ns() // 10**6, *(_written(v) + 1 for v in before[-1:]), 0)
    version = f"{database}.{name}__v{now:015d}_{uuid.uuid4().hex}"
    observed = Observation()
    exprs = [F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in (metrics or {}).items())]
    df.observe(observed, *exprs).write.format("parquet").saveAsTable(version)
    found = observed.get
    if found["n"] == 0 and keep_when_empty and exists(spark, table):
        spark.sql(f"DROP TABLE {_quoted(version)}")
        return found
    staged = spark.table(version).count()
    if staged != found["n"]:
        raise RuntimeError(f"staged {staged} of {found['n']} rows in {version}")
    if metrics:
        kept = json.dumps(found, default=str).replace("'", "\\'")
        spark.sql(f"ALTER TABLE {_quoted(version)} SET TBLPROPERTIES ('{OBSERVED}' = '{kept}')")
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table)} AS SELECT * FROM {_quoted(version)}")
    for old, successor in zip(before, before[1:]):
        if _written(successor) < now - KEEP_DAYS * 86_400_000:
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(old)}")
    return found


def observed(spark: SparkSession, table: str) -> dict:
    """What was observed while the published version was written; nothing where no one asked."""
    details = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect()}
    shown = re.search(r"`(\w+__v\d+_[0-9a-f]+)`", details.get("View Text") or "")
    if not shown:
        return {}
    version = f"{table.split('.')[0]}.{shown[1]}"
    properties = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(version)}").collect()}
    return json.loads(properties.get(OBSERVED, "{}"))


@contextmanager
def _dynamic(spark: SparkSession):
    """Overwrites replace the partitions that they write, and no others."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    held = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, held)


def overwrite_parts(
    df: DataFrame, table: str, part: str, parts: Sequence[str], rebalance: bool = True
) -> int:
    """Make the partitions ``parts`` hold exactly the rows of ``df``, and return their number.

    All other partitions stay untouched. ``df`` may read the table itself. Partitions left without rows
    are dropped after the write; a run that is lost in between is repeated by the caller with the
    same parts. Rebalancing splits a hot day over several files and joins small ones, by their
    measured sizes; rows that already lie by partition need none.
    """
    spark = df.sparkSession
    observed = Observation()
    rows = df.select(*[c for c in df.columns if c != part], part)
    rows = rows.hint("rebalance", F.col(part)) if rebalance else rows
    rows = rows.observe(observed, F.count(F.lit(1)).alias("n"), F.collect_set(part).alias("parts"))
    if not exists(spark, table):
        rows.write.format("parquet").partitionBy(part).saveAsTable(table)
    else:
        held = spark.table(table).columns
        with _dynamic(spark):
            rows.select(*held).write.insertInto(table, overwrite=True)
    filled = set(observed.get["parts"] or ())
    for value in parts:
        if value not in filled:
            spec = str(value).replace("'", "\\'")
            spark.sql(f"ALTER TABLE {_quoted(table)} DROP IF EXISTS PARTITION (`{part}` = '{spec}')")
    spark.catalog.refreshTable(table)
    return observed.get["n"]


def values_of(df: DataFrame, part: str) -> list[str]:
    """The distinct partition values of some rows, for a scan's filter: one a day or bucket."""
    rows = df.select(part).distinct().limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} values of {part}")
    return sorted(r[0] for r in rows if r[0] is not None)


def parts_of(spark: SparkSession, table: str) -> list[str]:
    """Values of a table's partition, from the catalog alone; partitions without rows are dropped."""
    rows = spark.sql(f"SHOW PARTITIONS {_quoted(table)}").collect()
    return sorted(unquote(r[0].split("=", 1)[1]) for r in rows)


def part_of(keys: Sequence[str], day: str | None = None) -> Column:
    """Partition of a row, from its key alone: the day of a key column, or a hash bucket."""
    if day is not None:
        return F.coalesce(F.date_format(F.col(day), "yyyy-MM-dd"), F.lit("none"))
    return F.format_string("%03d", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))


def merge_table(source: DataFrame, table: str, keys: Sequence[str], day: str | None = None) -> int:
    """Upsert by key: update all columns, insert new rows; the number of source rows.

    The source is written to its own table first: it runs once, and its true size decides how
    the partitions of the target meet it. ``day`` names the key column whose day is the partition.
    """
    spark = source.sparkSession
    staged = f"{table}__staged_{uuid.uuid4().hex}"
    unique_on(source, keys).withColumn(PART, part_of(keys, day)).write.format("parquet").saveAsTable(staged)
    try:
        incoming = spark.table(staged)
        rows = incoming.count()
        if not rows:
            return 0
        parts = values_of(incoming, PART)
        merged = incoming
        if exists(spark, table):
            held = spark.table(table).filter(F.col(PART).isin(parts))
            merged = merged_parts(held, incoming, keys)
        overwrite_parts(merged, table, PART, parts, rebalance=False)
        return rows
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(staged)}")


def merged_parts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the source's keys, and the source; null keys never match.

    An update of all columns is a removal and an insertion, so the target meets the source's keys in
    one anti join, which Spark broadcasts while the written source measures small: the target is not exchanged.
    """
    known = source.select(*keys)
    return target.join(known, list(keys), "left_anti").unionByName(source)


def publish_replace(df: DataFrame, table: str) -> int:
    """Replace a current-state mart; an empty source keeps the published version."""
    return replace_table(df, table, keep_when_empty=True)["n"]


def publish_merge(df: DataFrame, table: str, keys: Sequence[str], day: str | None = None) -> int:
    """Merge facts into a mart by key, partition by partition."""
    return merge_table(df, table, keys, day)


#: Key columns that name a day.
DAY_KEYS = ("hour_ts", "metric_date")


def publish(df: DataFrame, table: str, keys: Sequence[str] = ()) -> int:
    if not keys:
        return publish_replace(df, table)
    return publish_merge(df, table, keys, next((k for k in keys if k in DAY_KEYS), None))


def read_mart(spark: SparkSession, table: str) -> DataFrame:
    """A published mart, without its partition column."""
    return spark.table(table).drop(PART)
