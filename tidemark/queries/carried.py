"""Facts carried forward: state, counts and bitmaps of a first part, continued by the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import health, incremental, metrics
from tidemark.operators.incremental import DAY, day_of
from tidemark.plans import incremental as plan
from tidemark.plans.warehouse import Warehouse
from tidemark.queries import tables as t
from tidemark.queries.oracles import six
from tidemark.queries.registry import query
from tidemark.sources import files
from tidemark.streaming.ingest import DAY as INGESTED

CUT = "2024-01-20"


def _split(df, column, cut: str = CUT):
    return df.filter(F.col(column) < cut), df.filter(F.col(column) >= cut)


@query(
    "carried_trends",
    f"""SELECT tenant_id, topic, hour_ts, previous_posts, first_seen_at,
      {six('baseline_posts', 'baseline_post_stddev', 'velocity_z', 'novelty')}, trend_score
    FROM trend_hourly_v""",
)
def carried_trends(spark, folder):
    """Trend hours from 20 January on, scored from the state that the earlier hours left."""
    early, late = _split(metrics.topic_hourly(t.silver(spark, folder)), "hour_ts")
    first = metrics.trend_hourly(early)
    state = incremental.window_state(first, "topic", metrics.TREND_MEASURES, metrics.BASELINE_ROWS)
    rows = first.unionByName(metrics.trend_hourly(late, state=state))
    return t.plain(
        rows.select(
            "tenant_id", "topic", "hour_ts", "previous_posts", "first_seen_at", "baseline_posts",
            "baseline_post_stddev", "velocity_z", "novelty", "trend_score",
        )
    )


@query(
    "carried_snapshot",
    """SELECT tenant_id, challenge_name, hour_ts, participation_count, previous_participation,
      persistence_hours, challenge_score FROM challenge_snapshot_v""",
)
def carried_snapshot(spark, folder):
    """Newest hour of every challenge, out of a state that was rolled on once."""
    kept = ("challenge_name", metrics.CHALLENGE_MEASURES, metrics.CHALLENGE_ROWS)
    early, late = _split(metrics.challenge_participation(t.silver(spark, folder)), "hour_ts")
    state = incremental.window_state(metrics.challenge_scores(early), *kept)
    state = incremental.window_state(metrics.challenge_scores(late, state), *kept, state)
    return t.plain(
        incremental.latest_of(state).select(
            "tenant_id", "challenge_name", "hour_ts", "participation_count",
            "previous_participation", "persistence_hours", "challenge_score",
        )
    )


@query("merged_delivery", "SELECT * FROM delivery_v")
def merged_delivery(spark, folder):
    """Delivery counts out of latency counts and first-seen keys that were added up by day."""
    events = t.deliveries(spark, folder).withColumn(DAY, day_of("ingested_at"))
    early, late = _split(events, DAY)
    histogram = incremental.latency_histogram(early, DAY).unionByName(
        incremental.latency_histogram(late, DAY)
    )
    ledger = incremental.new_keys(early, None, DAY)
    ledger = ledger.unionByName(incremental.new_keys(late, ledger, DAY))
    return t.plain(health.merged_delivery(histogram, ledger))


@query(
    "bitmap_kpis",
    f"""SELECT tenant_id, data_through, posts_24h, creators_24h, views_24h, engagements_24h,
    {six('avg_engagement_rate_24h', 'positive_share_24h', 'negative_share_24h')},
    high_risk_mentions_24h, active_topics_24h FROM kpis_v""",
)
def bitmap_kpis(spark, folder):
    """Trailing measures from stored hours, ids and bitmaps of all posts."""
    w = _warehouse(spark)
    silver = t.silver(spark, folder).withColumn(DAY, day_of("created_at"))
    silver = w.replace("silver_social_posts", silver)
    plan.refresh_kpis(w, silver, [])
    return t.plain(plan.executive_kpis(w))


def _warehouse(spark) -> Warehouse:
    return Warehouse(spark, files.new_folder(spark, "warehouse"), f"tidemark_{uuid.uuid4().hex}")


_ACCEPTED_ROWS = """
SELECT 'brand_mentions' AS fact, tenant_id, CAST(metric_date AS VARCHAR) AS label, mentions::DOUBLE AS value
  FROM run_brand_daily_v
UNION ALL SELECT 'trend_score', tenant_id, topic || ' ' || strftime(hour_ts, '%Y-%m-%d %H'), trend_score
  FROM run_trend_hourly_v
UNION ALL SELECT 'challenge_score', tenant_id, challenge_name || ' ' || strftime(hour_ts, '%Y-%m-%d %H'),
    challenge_score FROM run_challenge_hourly_v
UNION ALL SELECT 'creators_24h', tenant_id, '', creators_24h::DOUBLE FROM run_kpis_v
UNION ALL SELECT 'active_topics_24h', tenant_id, '', active_topics_24h::DOUBLE FROM run_kpis_v
UNION ALL SELECT 'duplicate_deliveries', tenant_id, source_id, duplicate_deliveries::DOUBLE FROM source_health_v
UNION ALL SELECT 'latency_p95', tenant_id, source_id, collection_latency_p95_seconds::DOUBLE FROM source_health_v
UNION ALL SELECT 'rejected', tenant_id, source_id, rejected_events::DOUBLE FROM source_health_v
"""


@query("incremental_run", _ACCEPTED_ROWS)
def incremental_run(spark, folder):
    """Two runs over the bronze events; the second brings the last days and one late day of January."""
    w = _warehouse(spark)
    created = F.col("occurred_at")
    late = F.to_date(created) == F.lit("2024-01-10").cast("date")
    first = (created < CUT) & ~late
    at = F.when(first, F.lit("2024-01-20 06:00:00")).otherwise(F.lit("2024-01-31 06:00:00"))
    events = t.deliveries(spark, folder, full_payload=True).withColumn("ingested_at", at.cast("timestamp"))
    events = events.withColumn(INGESTED, F.to_date("ingested_at"))
    w.replace("control_event_contracts", t.contracts(spark))
    w.replace("control_source_registry", t.registry(spark))
    for rows in (events.filter(first), events.filter(~first)):
        rows.write.mode("append").partitionBy(INGESTED).parquet(w.path("bronze_social_events"))
        plan.refresh_increment(w)

    def fact(name, table, label, value):
        return table.select(
            F.lit(name).alias("fact"), "tenant_id", label.alias("label"), F.col(value).cast("double").alias("value")
        )

    def hour(entity):
        return F.concat_ws(" ", entity, F.date_format("hour_ts", "yyyy-MM-dd HH"))

    kpis, sources = plan.executive_kpis(w), plan.source_health(w, t.AS_OF)
    out = fact("brand_mentions", w.table("gold_brand_daily"), F.col("metric_date").cast("string"), "mentions")
    for more in (
        fact("trend_score", w.table("gold_trend_hourly"), hour("topic"), "trend_score"),
        fact("challenge_score", w.table("gold_challenge_hourly"), hour("challenge_name"), "challenge_score"),
        fact("creators_24h", kpis, F.lit(""), "creators_24h"),
        fact("active_topics_24h", kpis, F.lit(""), "active_topics_24h"),
        fact("duplicate_deliveries", sources, F.col("source_id"), "duplicate_deliveries"),
        fact("latency_p95", sources, F.col("source_id"), "collection_latency_p95_seconds"),
        fact("rejected", sources, F.col("source_id"), "rejected_events"),
    ):
        out = out.unionByName(more)
    return t.plain(out)
