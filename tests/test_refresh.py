"""The whole run: land, drain, refresh, gate, publish; twice, with the same result."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import quality
from tidemark.plans import read_packs, refresh
from tidemark.plans.warehouse import Warehouse
from tidemark.queries import tables as t
from tidemark.sources import files, tables

AS_OF = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def warehouse(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    w = Warehouse(spark, root, "refresh_tests")
    deliveries = t.deliveries(spark, folder, full_payload=True).drop("ingested_at")
    files.land_ndjson(deliveries, f"{root}/landing/events", files=4)
    files.land_ndjson(t.runs(spark, folder), f"{root}/landing/runs", files=2)
    landed = {"events": f"{root}/landing/events", "runs": f"{root}/landing/runs"}
    for _ in range(2):  # the second run finds nothing new
        refresh.ingest_landed(w, **landed)
    assert w.table("bronze_social_events").count() == deliveries.count()
    with pytest.raises(ValueError):
        w.replace("bronze_social_events", deliveries)
    w.replace("control_event_contracts", t.contracts(spark))
    w.replace("control_source_registry", t.registry(spark))
    w.replace("control_product_catalog", t.products(spark, folder))
    acme = [("t0", "ACME", "3", 1.0, 1.0, "owners", "owned-social", True, AS_OF),
            ("t1", "acme", "1", 1.0, 1.0, "owners", "owned-social", True, AS_OF)]
    brand_map = files.inline_values(spark, acme, schemas.SIGNAL_PRODUCT_MAP)
    w.replace("control_signal_product_map", t.signal_map(spark).unionByName(brand_map))
    w.replace("silver_human_labels", t.human_labels(spark, folder))
    refresh.refresh_all(w, AS_OF)
    return w


def test_every_product_table_is_filled(warehouse):
    names = [n for n in refresh.PRODUCT_TABLES if "trend" not in n or "hourly" in n]
    counts = files.table_row_counts(warehouse.tables(*names)).collect()
    assert all(r.row_count > 0 for r in counts)


def test_silver_is_unique_and_complete(warehouse):
    silver = warehouse.table("silver_social_posts")
    keys = ["tenant_id", "platform", "post_id"]
    assert silver.count() == silver.select(*keys).distinct().count()
    assert silver.filter("topic is null or engagements is null").isEmpty()
    assert "schema_version" not in silver.columns


def test_second_run_changes_nothing(warehouse):
    names = [
        "silver_social_posts", "gold_trend_hourly", "gold_signal_feed",
        "decision_recommendations", "decision_experiments",
    ]
    skipped = {"refreshed_at", "created_at", "updated_at", "event_attributes"}

    def content():
        out = {}
        for name in names:
            df = warehouse.table(name)
            kept = sorted(c for c in df.columns if c not in skipped)
            out[name] = sorted(repr(r) for r in df.select(*kept).collect())
        return out

    before = content()
    assert refresh.refresh_facts(warehouse, AS_OF) == []  # nothing new was ingested
    refresh.refresh_decisions(warehouse, AS_OF)
    assert content() == before
    assert refresh.rebuild_facts(warehouse, AS_OF) and content() == before


def test_decisions_survive_and_advance(warehouse, spark):
    recommendations = warehouse.table("decision_recommendations")
    assert recommendations.count() > 0
    warehouse.replace(
        "decision_recommendations", recommendations.withColumn("status", F.lit("APPROVED"))
    )
    refresh.refresh_decisions(warehouse, AS_OF)
    states = warehouse.table("decision_recommendations").select("status").distinct().collect()
    assert [r.status for r in states] == ["EXPERIMENT_PLANNED"]
    experiments = warehouse.table("decision_experiments")
    assert experiments.count() == recommendations.count()
    done = experiments.withColumns(
        {"status": F.lit("COMPLETED"), "control_revenue": F.lit(100.0),
         "treatment_revenue": F.lit(130.0), "actual_spend": F.lit(1.0)}
    )
    warehouse.replace("decision_experiments", done)
    refresh.refresh_decisions(warehouse, AS_OF)
    learned = warehouse.table("decision_learnings")
    assert learned.count() == experiments.count()
    assert [r.measured_lift_pct for r in learned.select("measured_lift_pct").distinct().collect()] == [30.0]
    card = warehouse.table("gold_pilot_scorecard").agg(F.sum("winning_experiments")).first()[0]
    assert card == learned.count()


def test_gates_and_read_packs(warehouse):
    names = [
        "bronze_social_events", "bronze_dead_letter_events", "control_source_registry",
        "silver_social_posts", "gold_challenge_snapshot", "gold_challenge_hourly",
        "gold_brand_daily", "gold_trend_hourly", "gold_trend_snapshot", "gold_topic_hourly",
        "gold_model_review_queue", "gold_source_health", "gold_signal_feed",
        "gold_opportunities", "gold_executive_kpis", "gold_connector_operations",
        "decision_recommendations", "decision_experiments", "gold_pilot_scorecard",
        "gold_experiment_performance",
    ]
    tables = warehouse.tables(*names)
    observed = warehouse.observed(*names)
    assert {"gold_signal_feed", "gold_opportunities", "gold_source_health"} <= observed.keys()
    checks = quality.product_checks(tables, AS_OF, observed)
    scanned = quality.product_checks(tables, AS_OF)
    assert checks.count() == 16 and sorted(checks.collect()) == sorted(scanned.collect())
    with pytest.raises(quality.QualityGateError, match="dead_letter_queue_is_empty"):
        quality.require_passing(checks)
    passing = {r.check_name for r in checks.filter("passed").collect()}
    assert {"post_ids_are_unique", "trend_scores_are_bounded",
            "recommendations_have_evidence_and_parent"} <= passing
    dashboard = read_packs.dashboard(tables, "t0", AS_OF)
    assert len(dashboard) == 18
    for name, df in dashboard.items():
        df.write.format("noop").mode("overwrite").save()
    assert dashboard["executive_pulse"].count() == 1
    assert len(read_packs.analyst_pack(tables)) == 10
    for df in read_packs.analyst_pack(tables).values():
        assert not df.isEmpty()
    assert len(read_packs.datasets(tables, "t0")) == 7
    for df in read_packs.datasets(tables, "t0").values():
        df.write.format("noop").mode("overwrite").save()


def test_publishing_all_marts(warehouse, spark):
    published = 0
    for name, keys in tables.DATASETS:
        mart = f"{warehouse.database}.published_{name}"
        published += tables.publish(warehouse.table(name), mart, keys) > 0
    empty = sum(warehouse.table(name).isEmpty() for name, _ in tables.DATASETS)
    assert published + empty == len(tables.DATASETS) == 13
    assert not schemas.DURABLE_TABLES.keys() & {"gold_topic_hourly"}
