"""Serving queries over the product tables: dashboard, analyst pack, datasets, alerts.

A read names its table, columns and order; a tenant filter reaches the scan. Reads that
compute something are functions of their own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics, quality


@dataclass(frozen=True)
class Read:
    """Columns of one table in one order. No columns: all; ``-c`` sorts descending."""

    table: str
    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=())

    def over(self, tables: Mapping[str, DataFrame], tenant_id: str | None = None) -> DataFrame:
        df = tables[self.table]
        if tenant_id is not None:
            df = df.filter(F.col("tenant_id") == tenant_id)
        if self.order:
            named = [c.lstrip("-") for c in self.order]
            # Equal keys are ordered by the other columns, so that every run reads alike.
            rest = [
                f.name
                for f in df.schema.fields
                if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))
            ]
            df = df.orderBy(
                *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order], *rest
            )
        return df.select(*self.columns) if self.columns else df


def _columns(text: str) -> tuple[str, ...]:
    return tuple(text.split())


KPIS = _columns(
    "data_through posts_24h creators_24h views_24h engagements_24h avg_engagement_rate_24h "
    "positive_share_24h negative_share_24h high_risk_mentions_24h active_topics_24h"
)
BRAND = _columns(
    "metric_date brand mentions unique_authors views engagements avg_engagement_rate "
    "positive_share negative_share net_sentiment high_risk_mentions"
)
OPPORTUNITY = _columns(
    "opportunity_id opportunity_type title product_id product_name preferred_channel "
    "target_audience opportunity_score confidence_score status evidence_count evidence_ref "
    "expires_at"
)
RECOMMENDATION = _columns(
    "recommendation_id opportunity_id product_id action_type channel hypothesis "
    "creative_brief primary_metric confidence_score status decided_by decision_reason "
    "updated_at"
)
EXPERIMENT = _columns(
    "experiment_id recommendation_id product_id channel status primary_metric "
    "target_lift_pct planned_budget actual_spend outcome measured_lift_pct "
    "incremental_revenue contribution_margin confidence_level start_at end_at"
)
CHALLENGE = _columns(
    "challenge_name hour_ts challenge_score participation_count participant_growth_pct "
    "unique_creators geography_count platform_count persistence_hours"
)
BEST_FIRST = ("-opportunity_score", "-signal_ts")

# Tenant-scoped dashboard reads.
DASHBOARD = {
    "executive_pulse": Read("gold_executive_kpis", KPIS),
    "trend_snapshot": Read(
        "gold_trend_snapshot",
        _columns(
            "hour_ts topic trend_score post_count creator_count platform_count "
            "geography_count velocity_z engagement_velocity_z acceleration_pct "
            "positive_share negative_share"
        ),
        ("-trend_score",),
    ),
    "trend_lifecycle": Read(
        "gold_trend_hourly",
        _columns("hour_ts topic trend_score post_count engagements velocity_z"),
        ("hour_ts", "topic"),
    ),
    "challenge_snapshot": Read("gold_challenge_snapshot", CHALLENGE, ("-challenge_score",)),
    "challenge_series": Read(
        "gold_challenge_hourly",
        _columns("hour_ts challenge_name participation_count unique_creators challenge_score"),
        ("hour_ts", "challenge_name"),
    ),
    "brand_health": Read("gold_brand_daily", BRAND, ("metric_date", "brand")),
    "signal_feed": Read(
        "gold_signal_feed",
        _columns("signal_type signal_key signal_ts score severity summary evidence_count"),
        ("-signal_ts", "-score"),
    ),
    "source_slo": Read(
        "gold_source_health",
        _columns(
            "source_id platform collection_mode health_status freshness_minutes "
            "delivered_events duplicate_deliveries rejected_events "
            "collection_latency_p95_seconds evaluated_at"
        ),
        ("-health_status", "source_id"),
    ),
    "opportunities": Read(
        "gold_opportunities", (*OPPORTUNITY, "signal_type", "signal_key"), BEST_FIRST
    ),
    "recommendation_queue": Read(
        "decision_recommendations", (*RECOMMENDATION, "target_audience"), ("-updated_at",)
    ),
    "scorecard": Read("gold_pilot_scorecard"),
    "experiments": Read("gold_experiment_performance", EXPERIMENT, ("-updated_at",)),
}

# Analyst reads over the published marts, all tenants.
ANALYST = {
    "executive_pulse": Read("gold_executive_kpis", KPIS, ("-data_through",)),
    "emerging_trends": Read(
        "gold_trend_snapshot",
        _columns(
            "hour_ts topic trend_score post_count creator_count platform_count "
            "geography_count views engagements acceleration_pct positive_share negative_share"
        ),
        ("-trend_score", "-engagements"),
    ),
    "challenges": Read(
        "gold_challenge_snapshot", CHALLENGE, ("-challenge_score", "-participation_count")
    ),
    "brand_health": Read("gold_brand_daily", BRAND, ("-metric_date", "-mentions")),
    "topic_performance": Read(
        "gold_topic_hourly",
        _columns(
            "hour_ts topic post_count creator_count platform_count views engagements "
            "avg_engagement_rate positive_share negative_share"
        ),
        ("-hour_ts", "-engagements"),
    ),
    "connector_operations": Read(
        "gold_connector_operations",
        _columns(
            "completed_at source_id platform status operational_status "
            "source_objects_discovered events_emitted search_calls_remaining "
            "core_units_remaining requests_remaining failed_runs_last_24 run_age_minutes"
        ),
        ("-completed_at", "source_id"),
    ),
    "opportunities": Read("gold_opportunities", OPPORTUNITY, BEST_FIRST),
    "recommendations": Read("decision_recommendations", RECOMMENDATION, ("-updated_at",)),
    "scorecard": Read("gold_pilot_scorecard", (), ("-evaluated_at",)),
    "experiments": Read("gold_experiment_performance", EXPERIMENT, ("-updated_at",)),
}

# Unordered dashboard datasets.
DATASETS = {
    "executive_kpis": Read(
        "gold_executive_kpis",
        _columns(
            "posts_24h creators_24h views_24h engagements_24h positive_share_24h "
            "negative_share_24h high_risk_mentions_24h active_topics_24h"
        ),
    ),
    "trend_snapshot": Read(
        "gold_trend_snapshot",
        _columns(
            "topic trend_score velocity_z acceleration_pct post_count creator_count "
            "positive_share negative_share"
        ),
    ),
    "challenge_snapshot": Read(
        "gold_challenge_snapshot",
        _columns(
            "challenge_name challenge_score participation_count participant_growth_pct "
            "unique_creators geography_count platform_count"
        ),
    ),
    "brand_daily": Read(
        "gold_brand_daily",
        _columns("metric_date brand mentions negative_share net_sentiment high_risk_mentions"),
    ),
    "signal_feed": Read(
        "gold_signal_feed", _columns("signal_type signal_key score severity evidence_count")
    ),
    "source_health": Read(
        "gold_source_health",
        _columns(
            "platform delivered_events rejected_events duplicate_deliveries "
            "freshness_minutes health_status"
        ),
    ),
}


def dashboard(
    tables: Mapping[str, DataFrame], tenant_id: str, as_of
) -> dict[str, DataFrame]:
    """All eighteen dashboard statements of one tenant, lazily."""
    posts = tables["silver_social_posts"]
    reads = {name: read.over(tables, tenant_id) for name, read in DASHBOARD.items()}
    return reads | {
        "platform_mix": metrics.platform_mix(posts, tenant_id),
        "brand_issues": metrics.top_brand_issues(posts, tenant_id),
        "data_operations": metrics.data_operations_summary(posts, tenant_id),
        "alert_emerging_trend": quality.emerging_trend_alert(
            tables["gold_trend_snapshot"], tenant_id
        ),
        "alert_brand_risk": quality.brand_risk_alert(tables["gold_brand_daily"], tenant_id),
        "alert_stale_feed": quality.stale_feed_alert(posts, tenant_id, as_of),
    }


def analyst_pack(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: read.over(tables) for name, read in ANALYST.items()}


def datasets(tables: Mapping[str, DataFrame], tenant_id: str) -> dict[str, DataFrame]:
    reads = {name: read.over(tables, tenant_id) for name, read in DATASETS.items()}
    return reads | {
        "risk_topics": metrics.risk_by_topic(tables["silver_social_posts"], tenant_id)
    }


def dashboard_measures(tables: Mapping[str, DataFrame], tenant_id: str) -> DataFrame:
    """The charted measures as (measure, label, value) rows."""

    def bars(table: str, name: str, label: str, value: Column) -> DataFrame:
        return (
            tables[table]
            .filter(F.col("tenant_id") == tenant_id)
            .groupBy(F.col(label).cast("string").alias("label"))
            .agg(value.cast("double").alias("value"))
            .select(F.lit(name).alias("measure"), "label", "value")
        )

    charts = [
        bars("gold_trend_snapshot", "trend_score", "topic", F.max("trend_score")),
        bars(
            "gold_challenge_snapshot", "challenge_score", "challenge_name",
            F.max("challenge_score"),
        ),
        bars("gold_brand_daily", "negative_share", "metric_date", F.avg("negative_share")),
        bars("gold_source_health", "delivered_events", "platform", F.sum("delivered_events")),
        bars("gold_signal_feed", "signal_score", "signal_key", F.max("score")),
    ]
    return reduce(lambda a, b: a.unionByName(b), charts)
