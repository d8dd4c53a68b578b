"""Canonical posts: delivery and post deduplication, enrichment, review sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.operators.rows import as_timestamp, latest_per_group, top_per_group

REVIEW_SAMPLE_SIZE = 50


def dedup_deliveries(deliveries: DataFrame) -> DataFrame:
    """One delivery per (tenant, idempotency key): the last collected one."""
    return latest_per_group(
        deliveries,
        ["tenant_id", "idempotency_key"],
        [F.desc("collected_at"), F.desc("ingested_at"), F.desc("event_id")],
    )


def canonical_posts(posts: DataFrame) -> DataFrame:
    """Posts with an identity, a creation time and a plausible reach."""
    return posts.filter(
        F.col("post_id").isNotNull()
        & F.col("platform").isNotNull()
        & F.col("created_at").isNotNull()
        & (F.col("views") >= 0)
    )


def dedup_posts(posts: DataFrame) -> DataFrame:
    """One row per (tenant, platform, post): the last collected one.

    The delivery id closes the order, so that equal times cannot change the result
    between runs.
    """
    return latest_per_group(
        posts,
        ["tenant_id", "platform", "post_id"],
        [F.desc("collected_at"), F.desc("ingested_at"), F.desc("event_id")],
    )


def enrich_posts(posts: DataFrame) -> DataFrame:
    """Add engagement, topic, sentiment and risk columns (all built-in expressions)."""
    engaged = scoring.engagements(*[F.col(c) for c in ("likes", "comments", "shares", "saves")])
    content = F.col("content_text")
    return posts.withColumns(
        {
            "engagements": engaged,
            "engagement_rate": scoring.engagement_rate(engaged, F.col("views")),
            "topic": text.classify_topic(content),
            "sentiment_label": text.classify_sentiment(content),
            "risk_level": text.classify_risk(content),
            "enrichment_model_version": F.lit(text.ENRICHMENT_VERSION),
        }
    )


def silver_posts(posts: DataFrame) -> DataFrame:
    """Validity filter, deduplication and enrichment in one plan (one shuffle)."""
    return enrich_posts(dedup_posts(canonical_posts(posts))).drop(
        "schema_version", "event_type", "source_object_id", "idempotency_key", "occurred_at",
        "event_attributes",
    )


def review_queue(posts: DataFrame, sample_size: int = REVIEW_SAMPLE_SIZE) -> DataFrame:
    """Newest posts per tenant and stratum (high risk, negative, other) for review."""
    stratum = (
        F.when(F.col("risk_level") == "high", F.lit(1))
        .when(F.col("sentiment_label") == "negative", F.lit(2))
        .otherwise(F.lit(3))
    )
    candidates = posts.select(
        "tenant_id",
        "platform",
        "post_id",
        "created_at",
        "content_text",
        F.col("topic").alias("predicted_topic"),
        F.col("sentiment_label").alias("predicted_sentiment"),
        F.col("risk_level").alias("predicted_risk_level"),
        "enrichment_model_version",
        stratum.alias("review_priority"),
    )
    return top_per_group(
        candidates,
        ["tenant_id", "review_priority"],
        [F.desc("created_at"), F.desc("platform"), F.desc("post_id")],
        sample_size,
    ).drop("_rank")


def model_quality_daily(posts: DataFrame, labels: DataFrame, as_of) -> DataFrame:
    """Accuracy of the enrichment against human labels by review day and rule version."""
    reviewed = labels.filter(F.col("post_id").isNotNull()).select(
        "tenant_id", "platform", "post_id", "reviewed_at", "reviewed_topic",
        "reviewed_sentiment", "reviewed_risk_level",
    )

    def accuracy(human: str, model: str):
        return F.avg(F.when(F.col(human) == F.col(model), F.lit(1.0)).otherwise(F.lit(0.0)))

    predictions = posts.select(
        "tenant_id", "platform", "post_id", "topic", "sentiment_label", "risk_level",
        "enrichment_model_version",
    )
    return (
        predictions.join(reviewed, ["tenant_id", "platform", "post_id"], "inner")
        .groupBy(
            "tenant_id",
            F.to_date(F.coalesce("reviewed_at", as_timestamp(as_of))).alias(
                "metric_date"
            ),
            "enrichment_model_version",
        )
        .agg(
            F.count(F.lit(1)).alias("reviewed_posts"),
            accuracy("reviewed_topic", "topic").alias("topic_accuracy"),
            accuracy("reviewed_sentiment", "sentiment_label").alias("sentiment_accuracy"),
            accuracy("reviewed_risk_level", "risk_level").alias("risk_accuracy"),
        )
    )
