"""Every read of the dashboard, analyst and dataset packs as a registered query."""

from __future__ import annotations

from tidemark.operators import metrics
from tidemark.plans import read_packs
from tidemark.queries import decisions, delivery, facts
from tidemark.queries import tables as t
from tidemark.queries.registry import query


def _hourly(spark, folder):
    return metrics.topic_hourly(t.silver(spark, folder))


def _trends(spark, folder):
    return metrics.trend_hourly(_hourly(spark, folder))


def _challenges(spark, folder):
    return metrics.challenge_hourly(t.silver(spark, folder))


# Product table -> (how Spark builds it, the view that states it in SQL).
TABLES = {
    "gold_executive_kpis": (lambda s, f: metrics.executive_kpis(t.silver(s, f)), "kpis_v"),
    "gold_topic_hourly": (_hourly, "topic_hourly_v"),
    "gold_trend_hourly": (_trends, "trend_hourly_v"),
    "gold_trend_snapshot": (
        lambda s, f: metrics.trend_snapshot(_trends(s, f)), "trend_snapshot_v",
    ),
    "gold_challenge_hourly": (_challenges, "challenge_hourly_v"),
    "gold_challenge_snapshot": (
        lambda s, f: metrics.challenge_snapshot(_challenges(s, f)), "challenge_snapshot_v",
    ),
    "gold_brand_daily": (lambda s, f: metrics.brand_daily(t.silver(s, f)), "brand_daily_v"),
    "gold_signal_feed": (facts.feed, "feed_v"),
    "gold_source_health": (delivery.health, "source_health_v"),
    "gold_connector_operations": (delivery.operations, "operations_v"),
    "gold_opportunities": (facts.opportunity_table, "opportunities_v"),
    "decision_recommendations": (t.recommendations, "recommendations_v"),
    "gold_experiment_performance": (decisions.performance, "performance_v"),
    "gold_pilot_scorecard": (decisions.scorecard, "scorecard_v"),
}
ROUNDED = (
    "_share", "_share_24h", "_rate", "_rate_24h", "_z", "net_sentiment", "acceleration_pct",
    "growth_pct",
)


def _sql_column(name: str) -> str:
    if name == "metric_date":
        return "CAST(metric_date AS VARCHAR) AS metric_date"
    if name.endswith(ROUNDED):
        return f"round({name}, 6) AS {name}"
    return name


def _register(pack: str, name: str, read: read_packs.Read, tenant_id: str | None) -> None:
    build, view = TABLES[read.table]
    columns = ", ".join(_sql_column(c) for c in read.columns) or "*"
    scope = f" WHERE tenant_id = '{tenant_id}'" if tenant_id else ""

    @query(f"{pack}_{name}", f"SELECT {columns} FROM {view}{scope}")
    def run(spark, folder):
        return t.plain(read.over({read.table: build(spark, folder)}, tenant_id))


for _name, _read in read_packs.DASHBOARD.items():
    _register("dashboard", _name, _read, t.TENANT)
for _name, _read in read_packs.ANALYST.items():
    _register("analyst", _name, _read, None)
for _name, _read in read_packs.DATASETS.items():
    _register("dataset", _name, _read, t.TENANT)
