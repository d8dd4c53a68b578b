"""Upserts of the control tables. Each returns the table's next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import merge_upsert, source, target, update_all
from tidemark.operators.rows import as_timestamp

_SECRETS = ("secret_scope", "secret_key")


def upsert_sources(
    registry: DataFrame, incoming: DataFrame, keep_secrets: bool = False
) -> DataFrame:
    """Register or refresh sources; ``keep_secrets`` leaves stored secret references."""
    keys = ["tenant_id", "source_id"]
    assigned = update_all(registry.columns, keys)
    if keep_secrets:
        assigned = {c: v for c, v in assigned.items() if c not in _SECRETS}
    return merge_upsert(registry, incoming, keys, when_matched=assigned)


def upsert_rules(
    rules: DataFrame,
    incoming: DataFrame,
    as_of,
    tenant_id: str | None = None,
    source_id: str | None = None,
) -> DataFrame:
    """Merge collection rules; with a tenant and source given, that source's rules
    missing from ``incoming`` are disabled."""
    keys = ["tenant_id", "rule_id"]
    clauses = {}
    if tenant_id is not None and source_id is not None:
        clauses = {
            "when_not_matched_by_source": {
                "enabled": F.lit(False),
                "updated_at": as_timestamp(as_of),
            },
            "not_matched_by_source_condition": (target("tenant_id") == tenant_id)
            & (target("source_id") == source_id),
        }
    return merge_upsert(
        rules, incoming, keys, when_matched=update_all(rules.columns, keys), **clauses
    )


def upsert_contracts(contracts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge event contracts; the first registration time stays."""
    updated = ("compatibility_mode", "payload_policy", "active")
    return merge_upsert(
        contracts,
        incoming,
        ["schema_version", "event_type"],
        when_matched={c: source(c) for c in updated},
    )


def upsert_products(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    keys = ["tenant_id", "product_id"]
    return merge_upsert(
        catalog, incoming, keys, when_matched=update_all(catalog.columns, keys)
    )


def upsert_signal_map(signal_map: DataFrame, incoming: DataFrame) -> DataFrame:
    keys = ["tenant_id", "signal_key", "product_id"]
    return merge_upsert(
        signal_map, incoming, keys, when_matched=update_all(signal_map.columns, keys)
    )
