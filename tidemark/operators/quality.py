"""Acceptance checks and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rows import as_timestamp

# Alert thresholds and acceptance limits; below, the names and texts of the checks.
ALERT_RULES = {
    "emerging_trend": (">=", 45.0),
    "brand_risk": (">=", 1.0),
    "source_freshness": (">", 90.0),
}
RECENT_HOURS = 2
LATEST_RUN_MINUTES = 180
TREND_ALERT_SCORE = 70.0
BRAND_ALERT_NEGATIVE_SHARE = 0.25
BRAND_ALERT_MENTIONS = 10
STALE_FEED_MINUTES = 30
CHALLENGE_NAME = "glowupchallenge"
# Bands from which a signal has an owner.
OWNERSHIP_BANDS = {"trend": 45.0, "challenge": 50.0, "brand": 0.25}


class QualityGateError(RuntimeError):
    """Raised when a required check fails; names every failed check."""


def _check(name: str, passed: Column, *detail: Column | str) -> Column:
    """One check row. Details are concatenated; plain strings are literals."""
    parts = [F.lit(d) if isinstance(d, str) else d.cast("string") for d in detail]
    return F.struct(
        F.lit(name).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.concat(*parts).alias("detail"),
    )


def _checks(df: DataFrame, measures: Mapping[str, Column], checks: Sequence[Column]) -> DataFrame:
    """All checks of one table from a single aggregate over it."""
    one_row = df.agg(*[c.alias(name) for name, c in measures.items()])
    return one_row.select(F.inline(F.array(*checks)))


def _measured(
    table: str, df: DataFrame, observed: Mapping[str, Mapping], checks: Sequence[Column]
) -> DataFrame:
    """All checks of one table: from what was observed while it was written, else from one scan."""
    measures, found = measures_of(table), observed.get(table, {})
    if not measures.keys() <= found.keys():
        return _checks(df, measures, checks)
    values = [F.lit(found[name]).cast("bigint").alias(name) for name in measures]
    return df.sparkSession.range(1).select(*values).select(F.inline(F.array(*checks)))


def _any_null(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def _out_of_range(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(n) < 0) | (F.col(n) > 100) for n in names])


def _orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with ``_orphan``: whether their parent row is missing."""
    present = parents.select(key).distinct().withColumn("_parent", F.lit(True))
    return children.join(present, key, "left").withColumn("_orphan", F.col("_parent").isNull())


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def measures_of(table: str) -> dict[str, Column]:
    """Counts of a table that its checks rest on; they can be observed while it is written."""
    n, m = F.count(F.lit(1)), F.col
    envelope = (
        "event_id", "tenant_id", "source_id", "schema_version", "idempotency_key", "payload",
    )
    known = {
        "control_source_registry": lambda: {"enabled": F.count_if("enabled")},
        "bronze_social_events": lambda: {"invalid": F.count_if(_any_null(*envelope))},
        "bronze_dead_letter_events": lambda: {"n": n},
        "gold_challenge_snapshot": lambda: {
            "matching": F.count_if(m("challenge_name") == CHALLENGE_NAME)
        },
        "gold_brand_daily": lambda: {"high_risk": F.sum("high_risk_mentions")},
        "gold_trend_hourly": lambda: {
            "invalid": F.count_if(_out_of_range("trend_score") | _any_null("trend_score"))
        },
        "gold_model_review_queue": lambda: {"n": n},
        "gold_source_health": lambda: {
            "n": n,
            "bad": F.count_if(m("health_status").isin("NO_DATA", "STALE", "DEGRADED")),
            "other": F.count_if(m("health_status") != "HEALTHY"),
        },
        "gold_signal_feed": lambda: {"n": n},
        "gold_opportunities": lambda: {
            "n": n,
            "bad": F.count_if(_out_of_range("opportunity_score", "confidence_score")),
        },
    }
    return known[table]() if table in known else {}


def product_checks(
    tables: Mapping[str, DataFrame], as_of, observed: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """Sixteen acceptance checks over the product tables, one scan per table.

    Tables whose counts were ``observed`` while they were written are not scanned again.
    """
    m = F.col
    now, newest = as_timestamp(as_of), m("newest")
    identity = F.concat_ws(":", "tenant_id", "platform", "post_id")

    def measured(table: str, *checks: Column) -> DataFrame:
        return _measured(table, tables[table], observed or {}, checks)

    silver = _checks(
        tables["silver_social_posts"],
        {
            "rows": F.count(F.lit(1)),
            "ids": F.count_distinct(identity),
            "invalid": F.count_if(_any_null("post_id", "author_id", "created_at", "topic")),
            "newest": F.max("created_at"),
        },
        [
            _check("silver_has_rows", m("rows") > 0, m("rows"), " canonical posts"),
            _check(
                "post_ids_are_unique", m("rows") == m("ids"), m("rows") - m("ids"), " duplicate IDs"
            ),
            _check("required_fields_are_complete", m("invalid") == 0, m("invalid"), " invalid rows"),
            _check(
                "data_is_recent",
                F.timestamp_diff("HOUR", newest, now) <= RECENT_HOURS,
                F.timestamp_diff("MINUTE", newest, now),
                " minutes old",
            ),
        ],
    )
    orphans = _orphans(
        tables["decision_experiments"].select("recommendation_id"),
        tables["decision_recommendations"],
        "recommendation_id",
    )
    available = (m("n") > 0) & (m("bad") == 0)
    return _union(
        [
            measured(
                "control_source_registry",
                _check(
                    "registered_sources_are_available", m("enabled") > 0, m("enabled"),
                    " enabled sources",
                ),
            ),
            measured(
                "bronze_social_events",
                _check(
                    "raw_events_have_required_envelope", m("invalid") == 0, m("invalid"),
                    " invalid envelopes",
                ),
            ),
            measured(
                "bronze_dead_letter_events",
                _check("dead_letter_queue_is_empty", m("n") == 0, m("n"), " rejected events"),
            ),
            silver,
            measured(
                "gold_challenge_snapshot",
                _check(
                    "challenge_is_detected", m("matching") > 0, m("matching"),
                    " matching challenge rows",
                ),
            ),
            measured(
                "gold_brand_daily",
                _check(
                    "brand_risk_is_detected", m("high_risk") > 0, m("high_risk"),
                    " high-risk mentions",
                ),
            ),
            measured(
                "gold_trend_hourly",
                _check(
                    "trend_scores_are_bounded", m("invalid") == 0, m("invalid"), " invalid scores"
                ),
            ),
            measured(
                "gold_model_review_queue",
                _check(
                    "model_review_queue_is_available", m("n") > 0, m("n"), " review candidates"
                ),
            ),
            measured(
                "gold_source_health",
                _check(
                    "source_health_is_available", available, m("n"), " sources; ", m("other"),
                    " non-healthy",
                ),
            ),
            measured(
                "gold_signal_feed",
                _check(
                    "experience_signal_feed_is_available", m("n") > 0, m("n"),
                    " actionable signals",
                ),
            ),
            measured(
                "gold_opportunities",
                _check(
                    "opportunity_scores_are_bounded", available, m("n"), " opportunities; ",
                    m("bad"), " invalid scores",
                ),
            ),
            _lineage_check(
                "recommendations_have_evidence_and_parent",
                tables["decision_recommendations"],
                tables["gold_opportunities"],
            ),
            _checks(
                orphans,
                {"n": F.count(F.lit(1)), "bad": F.count_if("_orphan")},
                [
                    _check(
                        "experiments_require_approved_recommendations", m("bad") == 0, m("n"),
                        " experiments; ", m("bad"), " orphaned",
                    )
                ],
            ),
        ]
    )


def _lineage_check(
    name: str, recommendations: DataFrame, opportunities: DataFrame
) -> DataFrame:
    m = F.col
    return _checks(
        _orphans(
            recommendations.select("opportunity_id", "evidence_ref"),
            opportunities,
            "opportunity_id",
        ),
        {
            "n": F.count(F.lit(1)),
            "bad": F.count_if(m("_orphan") | m("evidence_ref").isNull()),
        },
        [_check(name, m("bad") == 0, m("n"), " recommendations; ", m("bad"), " invalid records")],
    )


def external_checks(
    tables: Mapping[str, DataFrame], tenant_id: str, source_id: str
) -> DataFrame:
    """Six gates for one tenant's source: registration, last run, quota, delivery,
    quarantine and lineage of the tenant's recommendations."""
    m = F.col
    n = F.count(F.lit(1))

    def own(name: str) -> DataFrame:
        return tables[name].filter(
            (m("tenant_id") == tenant_id) & (m("source_id") == source_id)
        )

    has_quota = F.when(
        m("requests_remaining").isNotNull(), m("requests_remaining") > 0
    ).otherwise((m("search_calls_remaining") > 0) & (m("core_units_remaining") > 0))

    def known(name: str) -> Column:
        return F.coalesce(m(name), F.lit(-1))

    runs = _checks(
        own("gold_connector_operations"),
        {
            "fresh": F.count_if(
                (m("status") == "SUCCESS") & (m("run_age_minutes") <= LATEST_RUN_MINUTES)
            ),
            "last_status": F.max("status"),
            "age": F.max("run_age_minutes"),
            "funded": F.count_if(has_quota),
            "search": F.max("search_calls_remaining"),
            "core": F.max("core_units_remaining"),
            "requests": F.max("requests_remaining"),
        },
        [
            _check(
                "latest_collection_succeeded",
                m("fresh") == 1,
                "status=",
                F.coalesce(m("last_status"), F.lit("missing")),
                ", age_minutes=",
                known("age"),
            ),
            _check(
                "quota_headroom_is_positive",
                m("funded") == 1,
                "search_remaining=",
                known("search"),
                ", core_remaining=",
                known("core"),
                ", requests_remaining=",
                known("requests"),
            ),
        ],
    )
    return _union(
        [
            _checks(
                own("control_source_registry"),
                {"n": F.count_if("enabled")},
                [
                    _check(
                        "source_is_registered",
                        m("n") == 1,
                        m("n"),
                        " enabled source registrations",
                    )
                ],
            ),
            runs,
            _checks(
                own("bronze_social_events"),
                {"n": n},
                [_check("source_has_delivered_events", m("n") > 0, m("n"), " delivered events")],
            ),
            _checks(
                own("bronze_dead_letter_events"),
                {"n": n},
                [_check("source_dead_letter_is_empty", m("n") == 0, m("n"), " rejected events")],
            ),
            _lineage_check(
                "decision_records_have_valid_lineage",
                tables["decision_recommendations"].filter(m("tenant_id") == tenant_id),
                tables["gold_opportunities"],
            ),
        ]
    )


def require_passing(checks: DataFrame, title: str = "validation") -> DataFrame:
    """Return the checks, or raise with the name and detail of every failed one."""
    rows = checks.filter(~F.col("passed")).orderBy("check_name").collect()
    if rows:
        summary = "; ".join(f"{r.check_name}: {r.detail}" for r in rows)
        raise QualityGateError(f"{title} failed: {summary}")
    return checks


def alert_values(
    trend_snapshot: DataFrame, brand: DataFrame, health: DataFrame, tenant_id: str
) -> DataFrame:
    """The three scalar alert values of a tenant, as (alert_name, alert_value) rows."""

    def own(df: DataFrame) -> DataFrame:
        return df.filter(F.col("tenant_id") == tenant_id)

    def value(df: DataFrame, name: str, measure: Column) -> DataFrame:
        return df.agg(measure.cast("double").alias("alert_value")).select(
            F.lit(name).alias("alert_name"), "alert_value"
        )

    newest = own(brand).agg(F.max("metric_date")).scalar()
    return _union(
        [
            value(own(trend_snapshot), "emerging_trend", F.max("trend_score")),
            value(
                own(brand).filter(F.col("metric_date") == newest),
                "brand_risk",
                F.coalesce(F.sum("high_risk_mentions"), F.lit(0)),
            ),
            value(
                own(health).filter("enabled"), "source_freshness", F.max("freshness_minutes")
            ),
        ]
    )


def owned_signals(
    trend_snapshot: DataFrame,
    challenge_snapshot: DataFrame,
    brand: DataFrame,
    bands: Mapping[str, float] = OWNERSHIP_BANDS,
) -> DataFrame:
    """Signals in an ownership band: (tenant_id, signal, subject, value).

    A brand day also needs a high-risk mention.
    """

    def owned(df: DataFrame, signal: str, subject: Column, value: str) -> DataFrame:
        return df.filter(F.col(value) >= bands[signal]).select(
            "tenant_id",
            F.lit(signal).alias("signal"),
            subject.alias("subject"),
            F.col(value).cast("double").alias("value"),
        )

    risky = brand.filter(F.col("high_risk_mentions") > 0)
    day = F.concat_ws(" ", "brand", F.col("metric_date").cast("string"))
    return _union(
        [
            owned(trend_snapshot, "trend", F.col("topic"), "trend_score"),
            owned(challenge_snapshot, "challenge", F.col("challenge_name"), "challenge_score"),
            owned(risky, "brand", day, "negative_share"),
        ]
    )


def evaluate_alerts(
    values: DataFrame, rules: Mapping[str, tuple[str, float]] = ALERT_RULES
) -> DataFrame:
    """Compare alert values with their thresholds; no value reads as OK."""
    operator = F.when(F.lit(False), F.lit(""))
    threshold = F.when(F.lit(False), F.lit(0.0))
    for name, (comparison, limit) in rules.items():
        named = F.col("alert_name") == name
        operator = operator.when(named, F.lit(comparison))
        threshold = threshold.when(named, F.lit(limit))
    value = F.col("alert_value")
    breached = F.when(F.col("comparison") == ">=", value >= F.col("threshold")).when(
        F.col("comparison") == ">", value > F.col("threshold")
    )
    return values.withColumns({"comparison": operator, "threshold": threshold}).withColumn(
        "alert_state",
        F.when(F.coalesce(breached, F.lit(False)), F.lit("TRIGGERED")).otherwise(F.lit("OK")),
    )


def emerging_trend_alert(trend_snapshot: DataFrame, tenant_id: str) -> DataFrame:
    """Topics at or above the alert score; no rows when there is nothing to tell."""
    return (
        trend_snapshot.filter(
            (F.col("tenant_id") == tenant_id) & (F.col("trend_score") >= TREND_ALERT_SCORE)
        )
        .select("topic", "trend_score", "velocity_z", "acceleration_pct", "hour_ts")
        .orderBy(F.desc("trend_score"), "topic")
    )


def brand_risk_alert(brand: DataFrame, tenant_id: str) -> DataFrame:
    """Brands of the tenant's latest day with much negative and high-risk talk."""
    own = brand.filter(F.col("tenant_id") == tenant_id)
    newest = own.agg(F.max("metric_date")).scalar()
    return own.filter(
        (F.col("metric_date") == newest)
        & (F.col("negative_share") >= BRAND_ALERT_NEGATIVE_SHARE)
        & (F.col("high_risk_mentions") >= BRAND_ALERT_MENTIONS)
    ).select("metric_date", "brand", "negative_share", "high_risk_mentions")


def stale_feed_alert(posts: DataFrame, tenant_id: str, as_of) -> DataFrame:
    """One row when the tenant's newest post is over 30 minutes old."""
    newest = F.col("newest_post")
    return (
        posts.filter(F.col("tenant_id") == tenant_id)
        .agg(F.max("created_at").alias("newest_post"))
        .withColumn("minutes_old", F.timestamp_diff("MINUTE", newest, as_timestamp(as_of)))
        .filter(F.col("minutes_old") > STALE_FEED_MINUTES)
    )
