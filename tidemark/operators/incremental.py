"""Facts carried forward: touched days, window state per entity, mergeable counts.

Every operator here gives, from stored state and new rows, exactly what its whole-history
counterpart in ``posts``, ``metrics`` and ``health`` gives from all rows:

* ``upserted`` keeps the latest row per key, rewriting only the days that hold a touched key;
* ``window_state`` is what a topic's windows need of its past: the last rows, the first sighting, the
  latest row; ``with_carried`` puts it before new hours;
* ``latency_histogram`` and ``new_keys`` add up by day of ingestion;
* ``hour_bitmaps`` hold the distinct ids of an hour, which merge into those of any span of hours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rows import latest_per_group, top_per_group

DAY = "day"
#: Ids of one bitmap; fixed by Spark's bitmap functions.
BITMAP_IDS = 32_768


def day_of(at: Column | str) -> Column:
    """Day of an instant as the text of a partition; rows without one share a partition."""
    at = F.col(at) if isinstance(at, str) else at
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("none"))


# Latest row per key, by touched day.


def touched(stored: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Some columns of the stored rows whose key is among ``keys``.

    Only key columns are read, over all days; the few touched keys meet them where they lie.
    """
    return stored.select(*dict.fromkeys([*keys.columns, *columns])).join(keys, keys.columns, "left_semi")


def upserted(
    held: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The latest row per key of some days' stored rows and the new ones.

    Rows without a touched key pass by without a shuffle; only touched ones meet in the window.
    """
    known = incoming.select(*keys).distinct()
    old = held.join(known, list(keys), "left_semi")
    fresh = latest_per_group(old.unionByName(incoming), keys, order)
    return held.join(known, list(keys), "left_anti").unionByName(fresh)


# State of windows.


def window_state(
    rows: DataFrame,
    entity: str,
    measures: Sequence[str],
    keep: int,
    state: DataFrame | None = None,
) -> DataFrame:
    """What later hours need of each (tenant, entity): one row with

    ``recent``, the measures of its last ``keep`` hours in ascending order, ``first_seen_at``, and
    ``latest``, its newest row. ``rows`` follow those that ``state`` was made from. Each map task
    keeps only ``keep`` rows of an entity before the shuffle.
    """
    group = ["tenant_id", entity]
    item = F.struct("hour_ts", *measures)
    last = top_per_group(rows, group, [F.desc("hour_ts")], keep, "_rank")
    newest = F.struct(*[c for c in rows.columns])
    recent = last.select(*group, item.alias("item"), F.when(F.col("_rank") == 1, newest).alias("latest"))
    first = rows.groupBy(*group).agg(F.min("hour_ts").alias("first_seen_at"))
    made = (
        recent.groupBy(*group)
        .agg(F.sort_array(F.collect_list("item")).alias("recent"), F.first("latest", ignorenulls=True).alias("latest"))
        .join(first, group)
    )
    made = made.select(*group, "first_seen_at", "recent", "latest")
    if state is None:
        return made
    both = made.alias("n").join(state.alias("o"), group, "full_outer")
    joined = F.concat(F.coalesce("o.recent", F.array()), F.coalesce("n.recent", F.array()))
    return both.select(
        *group,
        F.least("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.slice(joined, F.greatest(F.size(joined) - keep + 1, F.lit(1)), keep).alias("recent"),
        F.coalesce("n.latest", "o.latest").alias("latest"),
    )


def with_carried(new: DataFrame, state: DataFrame | None, entity: str) -> DataFrame:
    """New hours behind the carried ones, which have ``_carried`` set; ``_first`` is the first sighting."""
    rows = new.withColumns({"_carried": F.lit(False), "_first": F.col("hour_ts")})
    if state is None:
        return rows
    past = state.select("tenant_id", entity, F.inline("recent"), F.col("first_seen_at").alias("_first"))
    return rows.unionByName(past.withColumn("_carried", F.lit(True)), allowMissingColumns=True)


def latest_of(state: DataFrame) -> DataFrame:
    """The newest row of every entity, out of its state."""
    return state.select("latest.*")


# Deliveries by day of ingestion.

SOURCE = ["tenant_id", "source_id"]


def latency() -> Column:
    """Seconds from occurrence to collection, not below zero."""
    passed = F.unix_timestamp("collected_at") - F.unix_timestamp("occurred_at")
    return F.greatest(F.lit(0).cast("bigint"), passed)


def latency_histogram(events: DataFrame, *by: str | Column) -> DataFrame:
    """Deliveries per source and second of latency, with their newest times. Adds up exactly."""
    return events.groupBy(*by, *SOURCE, latency().alias("seconds")).agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.max("collected_at").alias("collected_at"),
        F.max("ingested_at").alias("ingested_at"),
    )


def new_keys(events: DataFrame, ledger: DataFrame | None, day: str) -> DataFrame:
    """(source, key, day) of the delivery keys of these days that no earlier day has.

    The ledger is scanned for the new keys, which are the few; those found are taken out of
    the new ones. Null keys are no keys.
    """
    keys = [*SOURCE, "idempotency_key"]
    own = events.filter(F.col("idempotency_key").isNotNull())
    own = own.groupBy(*keys).agg(F.min(day).alias(day))
    if ledger is None:
        return own
    same = [own[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    probe = own.select(*[F.col(k).alias(f"_{k}") for k in keys])
    seen = ledger.select(*keys).join(probe, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    seen = seen.toDF(*[f"_{k}" for k in keys])
    return own.join(seen, same, "left_anti")


# Distinct ids as bitmaps.


def numbered_ids(values: DataFrame, first: int) -> DataFrame:
    """``id`` for every row, from ``first`` on: dense inside of each task, never one task's work."""
    return values.withColumn("id", F.monotonically_increasing_id() + F.lit(first))


def next_id(highest: int | None) -> int:
    """First id behind all ids of earlier runs."""
    return 0 if highest is None else ((highest >> 33) + 1) << 33


def members(posts: DataFrame, dimensions: Mapping[str, str]) -> DataFrame:
    """(tenant, hour, dimension, value) rows of the counted columns; nulls do not count."""
    listed = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()]
    )
    hour = F.date_trunc("hour", "created_at").alias("hour_ts")
    return posts.select("tenant_id", hour, F.inline(listed)).filter(F.col("value").isNotNull())


def hour_bitmaps(found: DataFrame, dictionary: DataFrame, *by: str) -> DataFrame:
    """One bitmap of ids per group, dimension and bucket of ``BITMAP_IDS`` ids."""
    known = dictionary.select("tenant_id", "dimension", "value", "id")
    distinct = found.select("tenant_id", *by, "dimension", "value").distinct()
    ids = distinct.join(known, ["tenant_id", "dimension", "value"])
    bucket = F.bitmap_bucket_number("id").alias("bucket")
    return ids.groupBy("tenant_id", *by, "dimension", bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")
    )


def distinct_counts(bitmaps: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Distinct values per tenant and dimension of all bitmaps together, a column each."""
    merged = bitmaps.groupBy("tenant_id", "dimension", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    count = F.bitmap_count("bitmap")
    return merged.groupBy("tenant_id").agg(
        *[F.sum(F.when(F.col("dimension") == d, count).otherwise(0)).alias(c) for d, c in names.items()]
    )
