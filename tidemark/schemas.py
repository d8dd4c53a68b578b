"""Declared schemas. Nothing in this library infers a schema from data.

Fixed values: names, types and order of the contract's columns.
"""

from __future__ import annotations

from pyspark.sql import types as T


# JSON writers cut timestamps to milliseconds unless told otherwise.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

_TYPES = {
    "STRING": T.StringType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "STRING_MAP": T.MapType(T.StringType(), T.StringType()),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """StructType of ``name TYPE [NOT NULL]`` items; needs no session, unlike DDL text."""
    fields = []
    for item in columns.split(","):
        name, kind, *required = item.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not required))
    return T.StructType(fields)


# Landed event envelope: two identities (delivery and logical event), opaque payload.
EVENT_ENVELOPE = _struct(
    """
    event_id STRING, schema_version STRING, tenant_id STRING, source_id STRING,
    platform STRING, event_type STRING, source_object_id STRING, occurred_at TIMESTAMP,
    collected_at TIMESTAMP, idempotency_key STRING, correlation_id STRING, payload STRING,
    attributes STRING_MAP
    """
)

POST_PAYLOAD = _struct(
    """
    post_id STRING, platform STRING, author_id STRING, author_followers BIGINT,
    content_text STRING, hashtags STRINGS, audio_id STRING, created_at TIMESTAMP,
    collected_at TIMESTAMP, views BIGINT, likes BIGINT, comments BIGINT, shares BIGINT,
    saves BIGINT, language STRING, geography STRING, brand STRING, source_payload STRING
    """
)

TREND_PAYLOAD = _struct(
    """
    platform STRING, trend_name STRING, tweet_count BIGINT, woeid BIGINT, location STRING,
    observed_at TIMESTAMP, source_payload STRING
    """
)

CONNECTOR_RUN = _struct(
    """
    run_id STRING, tenant_id STRING, source_id STRING, platform STRING, runtime STRING,
    started_at TIMESTAMP, completed_at TIMESTAMP, status STRING, active_rules BIGINT,
    videos_discovered BIGINT, posts_discovered BIGINT, trends_discovered BIGINT,
    events_emitted BIGINT, search_calls_used BIGINT, search_calls_remaining BIGINT,
    core_units_used BIGINT, core_units_remaining BIGINT, requests_used BIGINT,
    requests_remaining BIGINT, event_path STRING, error_type STRING
    """
)

SOURCE_REGISTRY = _struct(
    """
    tenant_id STRING NOT NULL, source_id STRING NOT NULL, platform STRING NOT NULL,
    connector_type STRING NOT NULL, collection_mode STRING NOT NULL, enabled BOOLEAN NOT NULL,
    event_schema_version STRING NOT NULL, poll_interval_seconds INT, secret_scope STRING,
    secret_key STRING, owner STRING NOT NULL, updated_at TIMESTAMP NOT NULL
    """
)

COLLECTION_RULES = _struct(
    """
    tenant_id STRING NOT NULL, rule_id STRING NOT NULL, source_id STRING NOT NULL,
    rule_type STRING NOT NULL, expression STRING NOT NULL, enabled BOOLEAN NOT NULL,
    updated_at TIMESTAMP NOT NULL
    """
)

EVENT_CONTRACTS = _struct(
    """
    schema_version STRING NOT NULL, event_type STRING NOT NULL,
    compatibility_mode STRING NOT NULL, payload_policy STRING NOT NULL,
    active BOOLEAN NOT NULL, registered_at TIMESTAMP NOT NULL
    """
)

PRODUCT_CATALOG = _struct(
    """
    tenant_id STRING NOT NULL, product_id STRING NOT NULL, product_name STRING NOT NULL,
    category STRING, gross_margin_rate DOUBLE, active BOOLEAN NOT NULL,
    updated_at TIMESTAMP NOT NULL
    """
)

SIGNAL_PRODUCT_MAP = _struct(
    """
    tenant_id STRING NOT NULL, signal_key STRING NOT NULL, product_id STRING NOT NULL,
    product_fit DOUBLE NOT NULL, commercial_fit DOUBLE NOT NULL, target_audience STRING,
    preferred_channel STRING, active BOOLEAN NOT NULL, updated_at TIMESTAMP NOT NULL
    """
)

RECOMMENDATIONS = _struct(
    """
    recommendation_id STRING NOT NULL, tenant_id STRING NOT NULL,
    opportunity_id STRING NOT NULL, product_id STRING, action_type STRING NOT NULL,
    channel STRING NOT NULL, target_audience STRING, hypothesis STRING NOT NULL,
    creative_brief STRING NOT NULL, primary_metric STRING NOT NULL,
    confidence_score DOUBLE NOT NULL, status STRING NOT NULL, evidence_ref STRING NOT NULL,
    created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL, decided_by STRING,
    decision_reason STRING
    """
)

EXPERIMENTS = _struct(
    """
    experiment_id STRING NOT NULL, tenant_id STRING NOT NULL,
    recommendation_id STRING NOT NULL, status STRING NOT NULL,
    primary_metric STRING NOT NULL, guardrail_metric STRING NOT NULL,
    target_lift_pct DOUBLE, control_definition STRING NOT NULL,
    treatment_definition STRING NOT NULL, planned_budget DOUBLE NOT NULL,
    actual_spend DOUBLE, control_conversions BIGINT, treatment_conversions BIGINT,
    control_revenue DOUBLE, treatment_revenue DOUBLE, start_at TIMESTAMP, end_at TIMESTAMP,
    created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL
    """
)

LEARNINGS = _struct(
    """
    learning_id STRING NOT NULL, tenant_id STRING NOT NULL, experiment_id STRING NOT NULL,
    recommendation_id STRING NOT NULL, outcome STRING NOT NULL, measured_lift_pct DOUBLE,
    incremental_revenue DOUBLE, contribution_margin DOUBLE,
    confidence_level STRING NOT NULL, reusable_insight STRING NOT NULL,
    recorded_at TIMESTAMP NOT NULL, recorded_by STRING NOT NULL
    """
)

HUMAN_LABELS = _struct(
    """
    tenant_id STRING, platform STRING, post_id STRING, reviewed_at TIMESTAMP,
    reviewer_id STRING, reviewed_topic STRING, reviewed_sentiment STRING,
    reviewed_risk_level STRING, review_notes STRING
    """
)

CURSORS = _struct(
    """
    tenant_id STRING, source_id STRING, rule_id STRING, cursor_at TIMESTAMP,
    updated_at TIMESTAMP
    """
)

EVIDENCE = _struct(
    """
    evidence_id STRING, tenant_id STRING, source_type STRING, source_ref STRING,
    observed_at TIMESTAMP, retrieved_at TIMESTAMP, trust_tier STRING, excerpt STRING,
    attributes STRING_MAP
    """
)

METRIC_POINTS = _struct(
    "tenant_id STRING, metric_name STRING, source_id STRING, observed_at TIMESTAMP, value DOUBLE"
)

SOURCE_STATUS = _struct(
    "tenant_id STRING, source_id STRING, status STRING, last_success_at TIMESTAMP"
)

# Tables that are declared up front. Refreshes leave control and label tables alone and write
# new versions of the decision tables that carry every earlier record on.
DURABLE_TABLES = {
    "control_source_registry": SOURCE_REGISTRY,
    "control_collection_rules": COLLECTION_RULES,
    "control_event_contracts": EVENT_CONTRACTS,
    "control_product_catalog": PRODUCT_CATALOG,
    "control_signal_product_map": SIGNAL_PRODUCT_MAP,
    "decision_recommendations": RECOMMENDATIONS,
    "decision_experiments": EXPERIMENTS,
    "decision_learnings": LEARNINGS,
    "silver_human_labels": HUMAN_LABELS,
}
