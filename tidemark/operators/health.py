"""Source health, connector operations, quota headroom and run statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.incremental import SOURCE, latency
from tidemark.operators.rows import as_timestamp, latest_per_group, top_per_group

# Service-level thresholds.
STALE_FLOOR_SECONDS = 900
DEFAULT_POLL_SECONDS = 300
STALE_POLLS = 3
STALE_RUN_MINUTES = 180
LATENCY_PERCENT = 95
FAILURE_WINDOW_RUNS = 24
LOW_SEARCH_CALLS = 5
LOW_CORE_UNITS = 500
LOW_REQUESTS = 5
QUOTA_TIME_ZONE = "America/Los_Angeles"
# Bucket -> (daily limit, operational reserve).
QUOTA_LIMITS = {"search": (100, 5), "core": (10_000, 500)}


def source_delivery(events: DataFrame) -> DataFrame:
    """Delivery counts, newest times and p95 collection latency per source, in one scan.

    Grouping sets reduce the deliveries inside the map tasks to one row per (source, latency second)
    and one per (source, delivery key); what follows works on counts.
    """
    seen = events.select(
        *SOURCE, "idempotency_key", "collected_at", "ingested_at", latency().alias("seconds")
    )
    sets = [[*SOURCE, "seconds"], [*SOURCE, "idempotency_key"]]
    counted = seen.groupingSets(
        [[F.col(c) for c in one] for one in sets],
        *[F.col(c) for c in (*SOURCE, "seconds", "idempotency_key")],
    ).agg(
        F.grouping("seconds").alias("_by_key"),
        F.count(F.lit(1)).alias("deliveries"),
        F.max("collected_at").alias("collected_at"),
        F.max("ingested_at").alias("ingested_at"),
    )
    of_key = F.col("_by_key") == 1
    # All keys of a source become one row, so that no window below sees a key.
    rows = counted.groupBy(*SOURCE, "_by_key", "seconds").agg(
        F.sum(F.when(~of_key, F.col("deliveries"))).alias("deliveries"),
        F.max("collected_at").alias("collected_at"),
        F.max("ingested_at").alias("ingested_at"),
        F.count(F.when(of_key, F.col("idempotency_key"))).alias("keys"),
    )
    return _delivery_summary(rows)


def merged_delivery(histogram: DataFrame, ledger: DataFrame) -> DataFrame:
    """``source_delivery`` out of the latency counts and first-seen keys kept by day of ingestion."""
    seconds = histogram.groupBy(*SOURCE, "seconds").agg(
        F.sum("deliveries").alias("deliveries"),
        F.max("collected_at").alias("collected_at"),
        F.max("ingested_at").alias("ingested_at"),
    )
    keys = ledger.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("keys"))
    rows = seconds.withColumn("keys", F.lit(0).cast("bigint"))
    return _delivery_summary(rows.unionByName(keys, allowMissingColumns=True))


def _delivery_summary(rows: DataFrame) -> DataFrame:
    """Sums and the exact p95 per source of rows by latency second.

    The percentile is the first second that covers 95 % of the deliveries. A window meets the
    distinct seconds of a source, 86,400 for each day of lateness at most, never its deliveries.
    """
    whole = Window.partitionBy(*SOURCE)
    up_to_here = whole.orderBy(F.asc_nulls_first("seconds")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    covered = F.sum("deliveries").over(up_to_here) * 100
    mark = F.sum("deliveries").over(whole) * LATENCY_PERCENT
    placed = rows.withColumn("_reached", covered >= mark)
    unique = F.sum("keys")
    delivered = F.sum("deliveries")
    return placed.groupBy(*SOURCE).agg(
        delivered.alias("delivered_events"),
        unique.alias("unique_logical_events"),
        (delivered - unique).alias("duplicate_deliveries"),
        F.max("collected_at").alias("last_collected_at"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.min(F.when(F.col("_reached"), F.col("seconds"))).alias("collection_latency_p95_seconds"),
    )


def source_rejections(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("tenant_id", "source_id").agg(
        F.count(F.lit(1)).alias("rejected_events")
    )


def _health_status(now: Column) -> Column:
    idle = F.timestamp_diff("SECOND", F.col("last_collected_at"), now)
    allowed = F.greatest(
        F.lit(STALE_FLOOR_SECONDS),
        F.coalesce("poll_interval_seconds", F.lit(DEFAULT_POLL_SECONDS)) * STALE_POLLS,
    )
    return (
        F.when(~F.col("enabled"), F.lit("DISABLED"))
        .when(F.col("last_collected_at").isNull(), F.lit("NO_DATA"))
        .when(idle > allowed, F.lit("STALE"))
        .when(F.col("rejected_events") > 0, F.lit("DEGRADED"))
        .otherwise(F.lit("HEALTHY"))
    )


def source_health(
    events: DataFrame, dead_letters: DataFrame, registry: DataFrame, as_of
) -> DataFrame:
    """Delivery, rejection, latency and freshness of every registered source."""
    return health_of(source_delivery(events), source_rejections(dead_letters), registry, as_of)


def health_of(
    delivery: DataFrame, rejections: DataFrame, registry: DataFrame, as_of
) -> DataFrame:
    """Health of every registered source from its delivery and rejection counts."""
    now = as_timestamp(as_of)
    counters = (
        "delivered_events",
        "unique_logical_events",
        "duplicate_deliveries",
        "rejected_events",
    )
    joined = registry.join(delivery, SOURCE, "left").join(rejections, SOURCE, "left")
    return joined.fillna(0, list(counters)).select(
        "tenant_id",
        "source_id",
        "platform",
        "connector_type",
        "collection_mode",
        "enabled",
        "poll_interval_seconds",
        "last_collected_at",
        "last_ingested_at",
        *counters,
        "collection_latency_p95_seconds",
        F.timestamp_diff("MINUTE", F.col("last_collected_at"), now).alias("freshness_minutes"),
        _health_status(now).alias("health_status"),
        now.alias("evaluated_at"),
    )


def failed_runs(runs: DataFrame, block: str = "day") -> DataFrame:
    """Rolling count of failures among each run and the 23 runs before it.

    Runs are counted inside time blocks, so that a source with most of the history is
    spread over many tasks. The 23 runs before a block come from the ends of the earlier
    blocks: every block keeps its last 23 runs, and only those meet per source.
    """
    source = ["tenant_id", "source_id"]
    before = FAILURE_WINDOW_RUNS - 1
    oldest_first = ["completed_at", "run_id"]
    failed = F.when(F.col("status") == "FAILED", F.lit(1)).otherwise(F.lit(0))
    blocked = runs.withColumn("_block", F.date_trunc(block, "completed_at"))

    ends = top_per_group(
        blocked.select(*source, "_block", *oldest_first, failed.alias("_failed")),
        [*source, "_block"],
        [F.desc(c) for c in oldest_first],
        before,
    )
    preceding = (
        Window.partitionBy(*source).orderBy(*oldest_first).rowsBetween(-before, -1)
    )
    carried = (
        ends.withColumn("_carried", F.collect_list("_failed").over(preceding))
        .groupBy(*source, "_block")
        .agg(F.max_by("_carried", "_rank").alias("_carried"))
    )

    in_block = Window.partitionBy(*source, "_block").orderBy(*oldest_first)
    own = F.sum(failed).over(in_block.rowsBetween(-before, Window.currentRow))
    counted = blocked.withColumns({"_own": own, "_position": F.row_number().over(in_block)})
    missing = F.least(
        F.size("_carried"), F.greatest(F.lit(0), F.lit(FAILURE_WINDOW_RUNS) - F.col("_position"))
    )
    newest = F.slice("_carried", -missing, missing)
    carried_failures = F.when(
        missing > 0, F.aggregate(newest, F.lit(0), lambda total, x: total + x)
    ).otherwise(F.lit(0))
    return counted.join(carried, [*source, "_block"], "left").select(
        *runs.columns,
        (F.col("_own") + carried_failures).cast("bigint").alias("failed_runs_last_24"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run of every source with its failures among the last 24 runs.

    Only the newest 24 runs of a source can matter for its latest run, so every map task
    prunes to them before the shuffle; a source with most of the history costs no more
    than the others.
    """
    source = ["tenant_id", "source_id"]
    newest_first = [F.desc("completed_at"), F.desc("run_id")]
    recent = top_per_group(runs, source, newest_first, FAILURE_WINDOW_RUNS)
    return (
        recent.withColumn(
            "failed_runs_last_24",
            F.count_if(F.col("status") == "FAILED").over(Window.partitionBy(*source)),
        )
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def connector_operations(runs: DataFrame, as_of) -> DataFrame:
    """Latest collection status, quota headroom and delivery counts per source."""
    now = as_timestamp(as_of)
    age = F.timestamp_diff("MINUTE", F.col("completed_at"), now)
    low_quota = (
        (F.col("search_calls_remaining") <= LOW_SEARCH_CALLS)
        | (F.col("core_units_remaining") <= LOW_CORE_UNITS)
        | (F.col("requests_remaining") <= LOW_REQUESTS)
    )
    discovered = [
        F.coalesce(c, F.lit(0))
        for c in ("videos_discovered", "posts_discovered", "trends_discovered")
    ]
    operational = (
        F.when(F.col("status") == "FAILED", F.lit("DEGRADED"))
        .when(age > STALE_RUN_MINUTES, F.lit("STALE"))
        .when(low_quota, F.lit("QUOTA_GUARD"))
        .otherwise(F.lit("HEALTHY"))
    )
    kept = [c for c in runs.columns if c != "ingested_at"]
    return latest_runs(runs).select(
        *kept,
        (discovered[0] + discovered[1] + discovered[2]).alias("source_objects_discovered"),
        "failed_runs_last_24",
        age.alias("run_age_minutes"),
        operational.alias("operational_status"),
        now.alias("evaluated_at"),
    )


def quota_headroom(
    usage: DataFrame,
    limits: Mapping[str, tuple[int, int]] = QUOTA_LIMITS,
    time_zone: str = QUOTA_TIME_ZONE,
) -> DataFrame:
    """Used, usable and remaining units per source, bucket and quota day.

    ``usage`` has (tenant_id, source_id, bucket, used_at, units). The quota day follows
    the provider's reset zone. Days without usage have no row.
    """
    day = F.to_date(F.convert_timezone(F.current_timezone(), F.lit(time_zone), "used_at"))
    usable = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for bucket, (limit, reserve) in limits.items():
        usable = usable.when(F.col("bucket") == bucket, F.lit(limit - reserve).cast("bigint"))
    return (
        usage.groupBy("tenant_id", "source_id", "bucket", day.alias("quota_day"))
        .agg(F.sum(F.greatest(F.lit(0).cast("bigint"), "units")).alias("used"))
        .withColumn("usable", usable)
        .withColumn(
            "remaining", F.greatest(F.lit(0).cast("bigint"), F.col("usable") - F.col("used"))
        )
    )


def batch_statistics(emitted: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules, discovered objects and emitted events of every collection run.

    ``emitted`` has (tenant_id, source_id, run_id, source_object_id, idempotency_key);
    an object found by two rules is emitted once per logical event.
    """
    source = ["tenant_id", "source_id"]
    active = (
        rules.filter("enabled")
        .groupBy(*source)
        .agg(F.count(F.lit(1)).alias("active_rules"))
    )
    per_run = emitted.groupBy(*source, "run_id").agg(
        F.count_distinct("source_object_id").alias("objects_discovered"),
        F.count_distinct("idempotency_key").alias("events_emitted"),
    )
    return per_run.join(active, source, "left").fillna(0, ["active_rules"])


_PUBLIC_COUNTS = (
    "active_rules",
    "videos_discovered",
    "events_emitted",
    "search_calls_remaining",
    "core_units_remaining",
)
_PUBLIC_TEXTS = ("run_id", "source_id", "platform", "runtime")


def public_status(runs: DataFrame, as_of) -> DataFrame:
    """Sanitised latest run per tenant's source: no paths, no payload, no tenant data.

    Incomplete records are left out; a run that reported healthy but is older than three
    hours reads as stale.
    """
    now = as_timestamp(as_of)
    age = F.greatest(
        F.lit(0).cast("bigint"), F.timestamp_diff("MINUTE", F.col("completed_at"), now)
    )
    reported = (
        F.when(F.col("status") == "FAILED", F.lit("DEGRADED"))
        .when(
            (F.col("search_calls_remaining") <= LOW_SEARCH_CALLS)
            | (F.col("core_units_remaining") <= LOW_CORE_UNITS),
            F.lit("QUOTA_GUARD"),
        )
        .otherwise(F.lit("HEALTHY"))
    )
    complete = F.col("status").isin("SUCCESS", "FAILED")
    for name in _PUBLIC_TEXTS:
        complete = complete & (F.length(name) > 0)
    for name in _PUBLIC_COUNTS:
        complete = complete & (F.col(name) >= 0)
    for name in ("started_at", "completed_at"):
        complete = complete & F.col(name).isNotNull()
    latest = latest_per_group(
        runs.filter(complete),
        ["tenant_id", "source_id"],
        [F.desc("completed_at"), F.desc("run_id")],
    )
    return (
        latest.withColumn("run_age_minutes", age)
        .withColumn("_reported", reported)
        .select(
            *_PUBLIC_TEXTS,
            "status",
            F.when(
                (F.col("_reported") == "HEALTHY")
                & (F.col("run_age_minutes") > STALE_RUN_MINUTES),
                F.lit("STALE"),
            )
            .otherwise(F.col("_reported"))
            .alias("operational_status"),
            "started_at",
            "completed_at",
            *_PUBLIC_COUNTS,
            F.coalesce("error_type", F.lit("")).alias("error_type"),
            "run_age_minutes",
        )
    )
