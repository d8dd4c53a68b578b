"""The scheduled runs: ingestion, analytics refresh, governance and decision loop.

Stages communicate through stored tables, as separate jobs would. Posts and facts are brought up to date
by the days that new rows touch; no stage recomputes the lineage of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import health, lifecycle, metrics, posts, signals
from tidemark.operators.incremental import DAY, latest_of
from tidemark.plans import incremental
from tidemark.plans.warehouse import Warehouse
from tidemark.streaming import ingest


def ingest_landed(
    w: Warehouse,
    events: str | None = None,
    runs: str | None = None,
    max_files: int = ingest.FILES_PER_TRIGGER,
) -> None:
    """Append everything newly landed to the bronze tables; each file exactly once."""
    if events:
        name = "bronze_social_events"
        ingest.read_event_stream(
            w.spark, events, w.checkpoint(name), path=w.path(name), max_files_per_trigger=max_files
        )
    if runs:
        name = "bronze_connector_runs"
        ingest.read_run_metric_stream(
            w.spark, runs, w.checkpoint(name), path=w.path(name), max_files_per_trigger=max_files
        )


def refresh_facts(w: Warehouse, as_of) -> list[str]:
    """Posts, facts and scores of the days that new rows touch, then the marts over them.

    Marts of the current state read window state, hours and counts, never all posts; the days of
    posts that were rewritten are returned.
    """
    days = incremental.refresh_increment(w)
    trends, challenges = (w.table(f"gold_{kind}_state") for kind in ("trend", "challenge"))
    w.view("bronze_social_posts", "bronze_accepted_posts", "post_id IS NOT NULL", (DAY, incremental.DELIVERED))
    named = "trend_name IS NOT NULL AND woeid IS NOT NULL"
    observed = w.view("bronze_social_trends", "bronze_accepted_trends", named, (DAY,))
    w.replace("gold_trending_topics", metrics.trending_topics(observed, as_of))
    trend_now = w.replace("gold_trend_snapshot", newest_state(trends))
    challenge_now = w.replace("gold_challenge_snapshot", newest_state(challenges))
    w.replace("gold_executive_kpis", incremental.executive_kpis(w))
    w.replace("gold_source_health", incremental.source_health(w, as_of))
    brand = w.table("gold_brand_daily").drop(DAY)
    w.replace("gold_signal_feed", signals.signal_feed(trend_now, challenge_now, brand))
    return days


def newest_state(states: DataFrame) -> DataFrame:
    """The latest row of every entity, out of the newest snapshot of its state."""
    newest = states.agg(F.max(DAY)).scalar()
    return latest_of(states.filter(F.col(DAY) == newest))


def rebuild_facts(w: Warehouse, as_of) -> list[str]:
    """All facts anew from all ingested rows."""
    w.drop(*incremental.BUILT, incremental.PROGRESS)
    return refresh_facts(w, as_of)


def refresh_operations(w: Warehouse, as_of) -> None:
    """Latest collection status per source."""
    w.replace(
        "gold_connector_operations",
        health.connector_operations(w.table("bronze_connector_runs"), as_of),
    )


def refresh_governance(w: Warehouse, as_of) -> None:
    """Review queue and model quality."""
    silver = w.table("silver_social_posts")
    w.replace("gold_model_review_queue", posts.review_queue(silver))
    w.replace(
        "gold_model_quality_daily",
        posts.model_quality_daily(silver, w.durable("silver_human_labels"), as_of),
    )


def refresh_decisions(w: Warehouse, as_of) -> None:
    """One turn of the decision loop.

    The order matters: proposals, then experiments of approved recommendations, then the
    experiments' states, then learnings. An approved recommendation is planned in the
    same turn.
    """
    products = w.durable("control_product_catalog")
    opportunities = w.replace(
        "gold_opportunities",
        signals.opportunities(
            w.table("gold_signal_feed"),
            w.durable("control_signal_product_map"),
            products,
            as_of,
        ),
    )
    recommendations = w.replace(
        "decision_recommendations",
        lifecycle.generate_recommendations(
            w.durable("decision_recommendations"), opportunities, as_of
        ),
    )
    experiments = w.replace(
        "decision_experiments",
        lifecycle.plan_experiments(w.durable("decision_experiments"), recommendations, as_of),
    )
    recommendations = w.replace(
        "decision_recommendations",
        lifecycle.sync_recommendation_status(recommendations, experiments, as_of),
    )
    learnings = w.replace(
        "decision_learnings",
        lifecycle.record_learnings(
            w.durable("decision_learnings"), experiments, recommendations, products, as_of
        ),
    )
    w.replace(
        "gold_experiment_performance",
        lifecycle.experiment_performance(experiments, recommendations, learnings),
    )
    w.replace(
        "gold_pilot_scorecard",
        lifecycle.pilot_scorecard(
            opportunities, recommendations, experiments, learnings, as_of
        ),
    )


def refresh_all(w: Warehouse, as_of) -> None:
    """The full scheduled run after ingestion."""
    refresh_facts(w, as_of)
    if w.exists("bronze_connector_runs"):
        refresh_operations(w, as_of)
    refresh_governance(w, as_of)
    refresh_decisions(w, as_of)


PRODUCT_TABLES = (
    "bronze_social_events",
    "bronze_dead_letter_events",
    "bronze_social_posts",
    "bronze_social_trends",
    "silver_social_posts",
    "gold_trending_topics",
    "gold_topic_hourly",
    "gold_trend_hourly",
    "gold_trend_snapshot",
    "gold_challenge_hourly",
    "gold_challenge_snapshot",
    "gold_brand_daily",
    "gold_executive_kpis",
    "gold_source_health",
    "gold_signal_feed",
)
