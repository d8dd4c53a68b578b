"""Registered queries over the given tables, and their SQL oracles."""

from tidemark.queries import (  # noqa: F401 - importing registers the queries
    carried,
    decisions,
    delivery,
    facts,
    packs,
    provider_feeds,
    serving,
)
from tidemark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
