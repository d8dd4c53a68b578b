"""Product tables of the given events, each written once and read by whatever rests on it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tidemark.operators import health, metrics, posts, signals
from tidemark.operators.envelope import dead_letter
from tidemark.plans.warehouse import Warehouse
from tidemark.queries import tables as t
from tidemark.sources import files

Build = Callable[["Stored"], DataFrame]

BUILD: dict[str, Build] = {
    "control_source_registry": lambda m: t.registry(m.spark),
    "bronze_dead_letter_events": lambda m: dead_letter(
        m["bronze_social_events"], t.contracts(m.spark), m["control_source_registry"]
    ),
    "silver_social_posts": lambda m: t.silver(m.spark, m.folder),
    "gold_topic_hourly": lambda m: metrics.topic_hourly(m["silver_social_posts"]),
    "gold_trend_hourly": lambda m: metrics.trend_hourly(m["gold_topic_hourly"]),
    "gold_trend_snapshot": lambda m: metrics.trend_snapshot(m["gold_trend_hourly"]),
    "gold_challenge_hourly": lambda m: metrics.challenge_hourly(m["silver_social_posts"]),
    "gold_challenge_snapshot": lambda m: metrics.challenge_snapshot(m["gold_challenge_hourly"]),
    "gold_brand_daily": lambda m: metrics.brand_daily(m["silver_social_posts"]),
    "gold_model_review_queue": lambda m: posts.review_queue(m["silver_social_posts"]),
    "gold_source_health": lambda m: health.source_health(
        m["bronze_social_events"], m["bronze_dead_letter_events"], m["control_source_registry"], t.AS_OF
    ),
    "gold_signal_feed": lambda m: signals.signal_feed(
        m["gold_trend_snapshot"], m["gold_challenge_snapshot"], m["gold_brand_daily"]
    ),
}


class Stored:
    """Tables by name; those in ``kept`` are written once to a new warehouse when first asked for.

    The others are read by one consumer only and stay lazy. The delivered events stay where they
    are: they are the given table.
    """

    def __init__(
        self, spark, folder: str, kept: Sequence[str], more: Mapping[str, Build] | None = None
    ):
        self.spark, self.folder, self.build = spark, folder, BUILD | dict(more or {})
        self.kept = frozenset(kept)
        self.warehouse = Warehouse(
            spark, files.new_folder(spark, "warehouse"), f"tidemark_{uuid.uuid4().hex}"
        )
        self.built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            if name == "bronze_social_events":
                self.built[name] = t.deliveries(self.spark, self.folder)
            else:
                rows = self.build[name](self)
                self.built[name] = self.warehouse.replace(name, rows) if name in self.kept else rows
        return self.built[name]

    def observed(self) -> dict[str, dict]:
        return self.warehouse.observed(*(name for name in self.built if name in self.kept))

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {name: self[name] for name in names}
