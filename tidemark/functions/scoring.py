"""Engagement, trend, challenge, brand-risk, opportunity and experiment formulas.

All scores are DOUBLE, lie in 0..100 and are rounded half-up to two digits.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and saturation points of the scores.
TREND_WEIGHTS = {
    "velocity": 30.0,
    "engagement_velocity": 20.0,
    "acceleration": 15.0,
    "creators": 10.0,
    "platforms": 10.0,
    "novelty": 10.0,
    "positivity": 5.0,
}
CHALLENGE_WEIGHTS = {
    "growth": 35.0,
    "creators": 25.0,
    "geographies": 15.0,
    "platforms": 15.0,
    "persistence": 10.0,
}
PRIORITY_WEIGHTS = {"signal": 0.55, "evidence": 0.15, "product": 0.20, "commercial": 0.10}
CONFIDENCE_WEIGHTS = {"signal": 0.45, "evidence": 0.20, "product": 0.20, "commercial": 0.15}
Z_SATURATION = 4.0
ACCELERATION_SATURATION = 2.0
GROWTH_SATURATION = 3.0
PLATFORM_SATURATION = 3.0
GEOGRAPHY_SATURATION = 5.0
PERSISTENCE_SATURATION_HOURS = 24.0
NOVELTY_DECAY_HOURS = 72.0
LOG_SATURATION = 100.0
CRITICAL_SCORE = 70.0
HIGH_SCORE = 45.0


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value.cast("double")))


def unit(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def saturating_log(count: Column) -> Column:
    """0..1 on a log scale that saturates at ``LOG_SATURATION``."""
    at_least_zero = F.greatest(F.lit(0.0), count.cast("double"))
    return unit(F.log1p(at_least_zero) / F.log1p(F.lit(LOG_SATURATION)))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Division as DOUBLE; NULL operands and a zero denominator give 0."""
    divided = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.coalesce(divided, F.lit(0.0))


def weighted(terms: Iterable[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in terms])


def score(value: Column) -> Column:
    return F.round(clamp(value), 2)


def nonneg_int(value: Column) -> Column:
    """Integer >= 0; fractions are cut off, NULL and text that is no number give 0."""
    cut = value.try_cast("decimal(38,9)").try_cast("bigint")
    number = F.coalesce(value.try_cast("bigint"), cut, F.lit(0).cast("bigint"))
    return F.greatest(F.lit(0).cast("bigint"), number)


def engagements(likes: Column, comments: Column, shares: Column, saves: Column) -> Column:
    return likes + comments + shares + saves


def engagement_rate(engaged: Column, views: Column) -> Column:
    return F.when(views > 0, engaged.cast("double") / views).otherwise(F.lit(0.0))


def novelty(hours_since_first: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - hours_since_first / F.lit(NOVELTY_DECAY_HOURS))


def trend_score(
    velocity_z: Column,
    engagement_velocity_z: Column,
    acceleration_pct: Column,
    creator_count: Column,
    platform_count: Column,
    novelty_share: Column,
    positive_share: Column,
    manipulation_penalty: Column | None = None,
) -> Column:
    w = TREND_WEIGHTS
    raw = weighted(
        [
            (w["velocity"], unit(velocity_z / Z_SATURATION)),
            (w["engagement_velocity"], unit(engagement_velocity_z / Z_SATURATION)),
            (w["acceleration"], unit(acceleration_pct / ACCELERATION_SATURATION)),
            (w["creators"], saturating_log(creator_count)),
            (w["platforms"], unit(platform_count / PLATFORM_SATURATION)),
            (w["novelty"], unit(novelty_share)),
            (w["positivity"], unit(positive_share)),
        ]
    )
    return score(raw if manipulation_penalty is None else raw - clamp(manipulation_penalty))


def challenge_score(
    participant_growth_pct: Column,
    unique_creators: Column,
    geography_count: Column,
    platform_count: Column,
    persistence_hours: Column,
) -> Column:
    w = CHALLENGE_WEIGHTS
    return score(
        weighted(
            [
                (w["growth"], unit(participant_growth_pct / GROWTH_SATURATION)),
                (w["creators"], saturating_log(unique_creators)),
                (w["geographies"], unit(geography_count / GEOGRAPHY_SATURATION)),
                (w["platforms"], unit(platform_count / PLATFORM_SATURATION)),
                (w["persistence"], unit(persistence_hours / PERSISTENCE_SATURATION_HOURS)),
            ]
        )
    )


def brand_risk_score(negative_share: Column, high_risk_mentions: Column) -> Column:
    mentions_part = F.least(F.lit(40.0), high_risk_mentions.cast("double") * 2.0)
    return score(negative_share * 60.0 + mentions_part)


def severity(value: Column) -> Column:
    return (
        F.when(value >= CRITICAL_SCORE, F.lit("critical"))
        .when(value >= HIGH_SCORE, F.lit("high"))
        .otherwise(F.lit("info"))
    )


def brand_severity(negative_share: Column, high_risk_mentions: Column) -> Column:
    return (
        F.when((high_risk_mentions >= 10) | (negative_share >= 0.5), F.lit("critical"))
        .when((high_risk_mentions > 0) | (negative_share >= 0.25), F.lit("high"))
        .otherwise(F.lit("info"))
    )


def _fit_terms(
    weights: dict[str, float],
    signal_score: Column,
    evidence_count: Column,
    product_fit: Column,
    commercial_fit: Column,
) -> list[tuple[float, Column]]:
    return [
        (weights["signal"], unit(signal_score / 100.0)),
        (weights["evidence"], saturating_log(evidence_count)),
        (weights["product"], unit(product_fit)),
        (weights["commercial"], unit(commercial_fit)),
    ]


def opportunity_score(
    signal_score: Column,
    evidence_count: Column,
    product_fit: Column,
    commercial_fit: Column,
    risk_penalty: Column | None = None,
) -> Column:
    raw = 100.0 * weighted(
        _fit_terms(PRIORITY_WEIGHTS, signal_score, evidence_count, product_fit, commercial_fit)
    )
    return score(raw if risk_penalty is None else raw - clamp(risk_penalty))


def confidence_score(
    signal_score: Column, evidence_count: Column, product_fit: Column, commercial_fit: Column
) -> Column:
    return score(
        100.0
        * weighted(
            _fit_terms(
                CONFIDENCE_WEIGHTS, signal_score, evidence_count, product_fit, commercial_fit
            )
        )
    )


def opportunity_status(product_id: Column, signal_score: Column) -> Column:
    return (
        F.when(product_id.isNull(), F.lit("NEEDS_MAPPING"))
        .when(signal_score >= HIGH_SCORE, F.lit("OPEN"))
        .otherwise(F.lit("WATCH"))
    )


def measured_lift_pct(control_revenue: Column, treatment_revenue: Column) -> Column:
    """Revenue lift in percent; NULL unless the control earned something."""
    lift = 100.0 * (treatment_revenue - control_revenue) / control_revenue
    return F.when(control_revenue > 0, F.round(lift, 2))


def contribution_margin(
    control_revenue: Column,
    treatment_revenue: Column,
    gross_margin_rate: Column,
    actual_spend: Column,
) -> Column:
    margin = (treatment_revenue - control_revenue) * F.coalesce(gross_margin_rate, F.lit(0.0))
    return F.round(margin - F.coalesce(actual_spend, F.lit(0.0)), 2)


def experiment_outcome(control_revenue: Column, treatment_revenue: Column) -> Column:
    return (
        F.when(treatment_revenue > control_revenue, F.lit("WIN"))
        .when(treatment_revenue == control_revenue, F.lit("INCONCLUSIVE"))
        .otherwise(F.lit("LOSS"))
    )


def valid_experiment(
    control_revenue: Column,
    treatment_revenue: Column,
    actual_spend: Column,
    gross_margin_rate: Column,
) -> Column:
    """Money is not negative and the margin rate is a share."""
    return F.coalesce(
        (control_revenue >= 0)
        & (treatment_revenue >= 0)
        & (actual_spend >= 0)
        & gross_margin_rate.between(0.0, 1.0),
        F.lit(False),
    )


def experiment_result(
    control_revenue: Column,
    treatment_revenue: Column,
    actual_spend: Column,
    gross_margin_rate: Column,
) -> Column:
    """Struct of validity, lift, incremental revenue and margin of one experiment."""
    valid = valid_experiment(control_revenue, treatment_revenue, actual_spend, gross_margin_rate)
    return F.struct(
        valid.alias("valid"),
        F.when(valid, measured_lift_pct(control_revenue, treatment_revenue)).alias(
            "measured_lift_pct"
        ),
        F.when(valid, treatment_revenue - control_revenue).alias("incremental_revenue"),
        F.when(
            valid,
            contribution_margin(
                control_revenue, treatment_revenue, gross_margin_rate, actual_spend
            ),
        ).alias("contribution_margin"),
    )
