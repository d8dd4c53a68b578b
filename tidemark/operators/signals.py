"""Unified signal feed and the commercial opportunities derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.identity import record_id
from tidemark.functions.text import fill

# Texts of signals and opportunities; {} marks inserted values.
TREND_SUMMARY = "Topic {} trend score {}"
CHALLENGE_SUMMARY = "Challenge {} score {}"
BRAND_SUMMARY = "{}: {} high-risk mentions"
DEFEND_TITLE = "Protect {}: {}"
GROW_TITLE = "Test {}: {}"
# Fits and channel of signals that no product is mapped to.
DEFAULT_FIT = 0.20
DEFAULT_CHANNEL = "analyst-review"


def _feed(
    df: DataFrame,
    signal_type: str,
    key: str,
    ts: Column,
    score: Column,
    severity: Column,
    summary: Column,
    evidence: str,
    table: str,
) -> DataFrame:
    return df.select(
        "tenant_id",
        F.lit(signal_type).alias("signal_type"),
        F.col(key).alias("signal_key"),
        ts.alias("signal_ts"),
        score.alias("score"),
        severity.alias("severity"),
        summary.alias("summary"),
        F.col(evidence).alias("evidence_count"),
        F.lit(table).alias("source_table"),
    )


def latest_brand_day(brand: DataFrame) -> DataFrame:
    """Brand rows of each tenant's own latest day (ties kept, pruned before the shuffle)."""
    newest_first = Window.partitionBy("tenant_id").orderBy(F.desc("metric_date"))
    return brand.withColumn("_rank", F.rank().over(newest_first)).filter("_rank = 1").drop("_rank")


def trend_signals(snapshot: DataFrame) -> DataFrame:
    score = F.col("trend_score")
    summary = fill(TREND_SUMMARY, "topic", score.cast("string"))
    return _feed(
        snapshot, "trend", "topic", F.col("hour_ts"), score, scoring.severity(score), summary,
        "post_count", "gold_trend_snapshot",
    )


def challenge_signals(snapshot: DataFrame) -> DataFrame:
    score = F.col("challenge_score")
    summary = fill(CHALLENGE_SUMMARY, "challenge_name", score.cast("string"))
    return _feed(
        snapshot, "challenge", "challenge_name", F.col("hour_ts"), score,
        scoring.severity(score), summary, "participation_count", "gold_challenge_snapshot",
    )


def brand_risk_signals(brand: DataFrame) -> DataFrame:
    negative, risky = F.col("negative_share"), F.col("high_risk_mentions")
    summary = fill(BRAND_SUMMARY, "brand", risky.cast("string"))
    return _feed(
        latest_brand_day(brand), "brand_risk", "brand", F.col("metric_date").cast("timestamp"),
        scoring.brand_risk_score(negative, risky), scoring.brand_severity(negative, risky),
        summary, "mentions", "gold_brand_daily",
    )


def signal_feed(trends: DataFrame, challenges: DataFrame, brand: DataFrame) -> DataFrame:
    """One row shape for trend, challenge and brand-risk signals."""
    return (
        trend_signals(trends)
        .unionByName(challenge_signals(challenges))
        .unionByName(brand_risk_signals(brand))
    )


def opportunities(
    signals: DataFrame, signal_map: DataFrame, products: DataFrame, refreshed_at=None
) -> DataFrame:
    """Signals with mapped products, scores, a stable id and their evidence reference.

    Signals that no product is mapped to stay, with default fits.
    """
    mapping = signal_map.filter("active").select(
        "tenant_id",
        F.lower("signal_key").alias("_key"),
        "product_id",
        "product_fit",
        "commercial_fit",
        "target_audience",
        "preferred_channel",
    )
    catalog = products.filter("active").select("tenant_id", "product_id", "product_name")
    candidates = (
        signals.withColumn("_key", F.lower("signal_key"))
        .join(mapping, ["tenant_id", "_key"], "left")
        .join(catalog, ["tenant_id", "product_id"], "left")
        .withColumns(
            {
                "product_fit": F.coalesce("product_fit", F.lit(DEFAULT_FIT)),
                "commercial_fit": F.coalesce("commercial_fit", F.lit(DEFAULT_FIT)),
                "preferred_channel": F.coalesce("preferred_channel", F.lit(DEFAULT_CHANNEL)),
            }
        )
    )
    defend = F.col("signal_type") == "brand_risk"
    subject = F.coalesce("product_name", "signal_key")
    inputs = [F.col(c) for c in ("score", "evidence_count", "product_fit", "commercial_fit")]
    stamp = F.current_timestamp() if refreshed_at is None else F.lit(refreshed_at)
    lifetime = F.when(defend, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 7 DAYS"))
    return candidates.select(
        record_id(
            F.col("tenant_id"),
            F.col("signal_type"),
            F.col("signal_key"),
            F.coalesce("product_id", F.lit("unmapped")),
            F.to_date("signal_ts").cast("string"),
        ).alias("opportunity_id"),
        "tenant_id",
        F.when(defend, F.lit("DEFEND")).otherwise(F.lit("GROW")).alias("opportunity_type"),
        "signal_type",
        "signal_key",
        "signal_ts",
        "product_id",
        "product_name",
        "preferred_channel",
        "target_audience",
        F.col("score").alias("signal_score"),
        "evidence_count",
        "product_fit",
        "commercial_fit",
        scoring.opportunity_score(*inputs).alias("opportunity_score"),
        scoring.confidence_score(*inputs).alias("confidence_score"),
        scoring.opportunity_status(F.col("product_id"), F.col("score")).alias("status"),
        F.when(defend, fill(DEFEND_TITLE, subject, "summary"))
        .otherwise(fill(GROW_TITLE, subject, "summary"))
        .alias("title"),
        F.to_json(
            F.struct("signal_type", "signal_key", "signal_ts", "source_table", "evidence_count")
        ).alias("evidence_ref"),
        F.col("signal_ts").alias("first_detected_at"),
        (F.col("signal_ts") + lifetime).alias("expires_at"),
        stamp.cast("timestamp").alias("refreshed_at"),
    )


def attest_scores(receipts: DataFrame) -> DataFrame:
    """Recompute the scores of receipts from their inputs and compare.

    A receipt has the four inputs, an optional ``risk_penalty``, and the claimed
    ``priority_score`` and ``confidence_score``.
    """
    inputs = [
        F.col(c) for c in ("signal_score", "evidence_count", "product_fit", "commercial_fit")
    ]
    penalty = (
        F.coalesce("risk_penalty", F.lit(0.0)) if "risk_penalty" in receipts.columns else None
    )
    complete = inputs[0].isNotNull()
    for c in inputs[1:]:
        complete = complete & c.isNotNull()
    return (
        receipts.withColumns(
            {
                "expected_priority": scoring.opportunity_score(*inputs, penalty),
                "expected_confidence": scoring.confidence_score(*inputs),
            }
        )
        .withColumn(
            "attested",
            complete
            & F.col("priority_score").eqNullSafe(F.col("expected_priority"))
            & F.col("confidence_score").eqNullSafe(F.col("expected_confidence")),
        )
    )
