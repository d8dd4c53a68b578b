from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import control, lifecycle, quality, serving
from tidemark.queries import tables as t
from tidemark.sources.files import inline_values

AT = datetime(2024, 2, 1)


def recommendation(key, status="PROPOSED", evidence="ref"):
    return (key, "t0", f"o-{key}", "p", "CREATIVE_TEST", "c", None, "h", "b", "m", 50.0, status,
            evidence, datetime(2024, 1, 1), datetime(2024, 1, 1), None, None)


@pytest.fixture
def recs(spark):
    def build(*rows):
        return inline_values(spark, list(rows), schemas.RECOMMENDATIONS)

    return build


def test_transitions(rows):
    df = rows(
        "current_status STRING, requested_status STRING",
        ("proposed", " Approved "), ("PROPOSED", "RUNNING"), ("COMPLETED", "RUNNING"),
        ("UNKNOWN", "APPROVED"), (None, "APPROVED"), ("RUNNING", None),
    )
    got = [r.violation for r in lifecycle.check_transitions(df).collect()]
    assert got == [
        None, "invalid_transition", "invalid_transition", "unknown_status", "unknown_status",
        "invalid_transition",
    ]


def test_approved_recommendation_is_planned_and_synced_once(spark, recs):
    before = recs(recommendation("r1", "APPROVED"), recommendation("r2"))
    none = inline_values(spark, [], schemas.EXPERIMENTS)
    planned = lifecycle.plan_experiments(none, before, AT)
    assert planned.count() == 1
    assert lifecycle.plan_experiments(planned, before, AT).count() == 1
    synced = lifecycle.sync_recommendation_status(before, planned, AT)
    assert {r.recommendation_id: r.status for r in synced.collect()} == {
        "r1": "EXPERIMENT_PLANNED", "r2": "PROPOSED",
    }


def test_sync_overwrites_unless_strict(spark, recs):
    before = recs(recommendation("r1", "REJECTED"))
    plan = lifecycle.plan_experiments(
        inline_values(spark, [], schemas.EXPERIMENTS), recs(recommendation("r1", "APPROVED")), AT
    )
    loose = lifecycle.sync_recommendation_status(before, plan, AT).first()
    strict = lifecycle.sync_recommendation_status(before, plan, AT, strict=True).first()
    assert (loose.status, strict.status) == ("EXPERIMENT_PLANNED", "REJECTED")


def test_approvals(recs, rows):
    before = recs(
        recommendation("ok"), recommendation("done", "APPROVED"), recommendation("bare", evidence=" "),
        recommendation("anon"),
    )
    decisions = rows(
        "recommendation_id STRING, actor STRING, reason STRING",
        ("ok", " Ann ", "checked"), ("done", "Ann", "r"), ("bare", "Ann", "r"),
        ("anon", " ", "r"), ("ghost", "Ann", "r"),
    )
    after, refused = lifecycle.apply_approvals(before, decisions, AT)
    ok = after.filter("recommendation_id = 'ok'").first()
    assert (ok.status, ok.decided_by, ok.decision_reason) == ("APPROVED", "Ann", "checked")
    assert after.count() == 4 and after.filter("decided_by is not null").count() == 1
    assert {r.recommendation_id: r.rejection for r in refused.collect()} == {
        "done": "not_proposed", "bare": "no_evidence", "anon": "actor_and_reason",
        "ghost": "not_proposed",
    }


def test_regenerating_never_touches_decided_rows(spark, recs, rows):
    opportunities = rows(
        "opportunity_id STRING, tenant_id STRING, opportunity_type STRING, signal_key STRING, "
        "product_id STRING, product_name STRING, preferred_channel STRING, "
        "target_audience STRING, status STRING, opportunity_score DOUBLE, "
        "confidence_score DOUBLE, evidence_ref STRING",
        ("o1", "t0", "GROW", "k", "p", "P", "new", "a", "OPEN", 80.0, 70.0, "e"),
        ("o2", "t0", "DEFEND", "k", "p", "P", "new", "a", "OPEN", 44.9, 70.0, "e"),
    )
    first = lifecycle.generate_recommendations(recs(), opportunities, AT)
    assert [r.status for r in first.collect()] == ["PROPOSED"]
    decided = first.withColumns({"status": F.lit("APPROVED"), "channel": F.lit("kept")})
    again = lifecycle.generate_recommendations(decided, opportunities, AT).first()
    assert (again.status, again.channel) == ("APPROVED", "kept")
    open_row = first.withColumn("channel", F.lit("stale"))
    assert lifecycle.generate_recommendations(open_row, opportunities, AT).first().channel == "new"


def test_learnings_are_immutable(spark, folder):
    args = (
        t.experiments(spark, folder, completed=True), t.recommendations(spark, folder),
        t.products(spark, folder),
    )
    measured = lifecycle.measured_learnings(*args, AT)
    kept = measured.withColumn("outcome", F.lit("KEPT"))
    assert lifecycle.record_learnings(kept, *args, AT).filter("outcome <> 'KEPT'").isEmpty()


def test_drafts(rows):
    schema = (
        "tenant_id STRING, opportunity_id STRING, action_type STRING, channel STRING, "
        "hypothesis STRING, creative_brief STRING, primary_metric STRING, "
        "confidence_score DOUBLE, evidence_ids ARRAY<STRING>"
    )
    good = ("demo", "opp", "A", "c", "h", "b", "m", 76.0, ["ev-2", " ev-1", "ev-1", ""])
    drafts, refused = lifecycle.draft_recommendation(
        rows(schema, good, (*good[:3], " ", *good[4:]), (*good[:7], 101.0, []))
    )
    draft = drafts.first()
    assert drafts.count() == 1 and draft.evidence_ids == ["ev-1", "ev-2"]
    assert (draft.status, draft.mutation, draft.approval_required) == ("PROPOSED", "none", True)
    assert sorted(r.refusal for r in refused.collect()) == [
        "confidence_out_of_range,no_evidence", "missing_channel",
    ]


def test_experiment_gate_needs_an_approval(recs, rows):
    approvals = rows("recommendation_id STRING, status STRING", ("a", "APPROVED"), ("b", "REJECTED"))
    plans = lifecycle.experiment_gate(recs(recommendation("a"), recommendation("b")), approvals)
    assert [(r.recommendation_id, r.status) for r in plans.collect()] == [
        ("a", "EXPERIMENT_PLANNED")
    ]


def test_rules_of_other_sources_stay_enabled(spark):
    def rule(key, source, enabled=True, tenant="t0"):
        return (tenant, key, source, "keyword", "e", enabled, datetime(2024, 1, 1))

    old = inline_values(
        spark,
        [rule("keep", "s"), rule("drop", "s"), rule("other", "z"), rule("drop", "s", tenant="t9")],
        schemas.COLLECTION_RULES,
    )
    new = inline_values(spark, [rule("keep", "s"), rule("new", "s")], schemas.COLLECTION_RULES)
    merged = control.upsert_rules(old, new, AT, tenant_id="t0", source_id="s")
    assert {(r.tenant_id, r.rule_id): r.enabled for r in merged.collect()} == {
        ("t0", "keep"): True, ("t0", "drop"): False, ("t0", "other"): True,
        ("t9", "drop"): True, ("t0", "new"): True,
    }


def test_source_secrets(spark):
    def source(secret, platform):
        return [("t", "s", platform, "c", "m", True, "1.0", 1, secret, secret, "o", AT)]

    old = inline_values(spark, source("kept", "a"), schemas.SOURCE_REGISTRY)
    new = inline_values(spark, source(None, "b"), schemas.SOURCE_REGISTRY)
    kept = control.upsert_sources(old, new, keep_secrets=True).first()
    assert (kept.secret_key, kept.platform) == ("kept", "b")
    assert control.upsert_sources(old, new).first().secret_key is None


def test_contract_registration_time_stays(spark):
    old = inline_values(
        spark, [("1.0", "e", "A", "P", True, datetime(2020, 1, 1))], schemas.EVENT_CONTRACTS
    )
    new = inline_values(spark, [("1.0", "e", "B", "P", False, AT)], schemas.EVENT_CONTRACTS)
    row = control.upsert_contracts(old, new).first()
    assert (row.compatibility_mode, row.active, row.registered_at) == (
        "B", False, datetime(2020, 1, 1),
    )


# --- serving and gates ---------------------------------------------------------------


@pytest.fixture
def listed(rows):
    return rows(
        "tenant_id STRING, opportunity_id STRING, opportunity_score DOUBLE, "
        "signal_ts TIMESTAMP, status STRING",
        ("demo", "high", 88.0, AT, "OPEN"), ("demo", "low", 10.0, AT, "watch"),
        ("other", "top", 99.0, AT, "OPEN"),
    )


def test_list_opportunities(listed):
    page = serving.list_opportunities(listed, "demo", limit=1)
    assert [r.opportunity_id for r in page.items.collect()] == ["high"]
    s = page.summary.first()
    assert (s.returned, s.available, s.next_page) == (1, 2, True)
    page = serving.list_opportunities(listed, "demo", status=" Watch ", min_score=5)
    assert [r.opportunity_id for r in page.items.collect()] == ["low"]


@pytest.mark.parametrize("bad", ["../other", "", "a b", "-x", "a" * 64])
def test_tenant_ids_are_checked(listed, bad):
    with pytest.raises(ValueError):
        serving.tenant_scope(listed, bad)


def test_allow_list_limits_and_scores(listed):
    with pytest.raises(PermissionError):
        serving.list_opportunities(listed, "demo", allowed={"other"})
    for limit in (0, 101, True, "5"):
        with pytest.raises(ValueError):
            serving.list_opportunities(listed, "demo", limit=limit)
    with pytest.raises(ValueError):
        serving.list_opportunities(listed, "demo", min_score=101)


def test_source_statuses(rows):
    df = rows(
        "tenant_id STRING, source_id STRING, status STRING",
        ("a", "s1", "healthy"), ("a", "s2", None), ("b", "s1", "healthy"),
    )
    assert serving.source_statuses(df, "b").summary.first().healthy is True
    assert serving.source_statuses(df, "a").summary.first().healthy is False
    assert serving.source_statuses(df, "a", "s1").summary.first().healthy is True
    assert serving.source_statuses(df, "none").summary.first().healthy is False


def test_evidence_of_another_tenant_is_missing(rows):
    references = rows(
        "tenant_id STRING, opportunity_id STRING, evidence_ids ARRAY<STRING>", ("a", "o", ["e"])
    )
    evidence = rows("tenant_id STRING, evidence_id STRING", ("b", "e"))
    found, missing = serving.evidence_lookup(references, evidence)
    assert found.isEmpty() and missing.count() == 1


def test_alert_thresholds(rows):
    values = rows(
        "alert_name STRING, alert_value DOUBLE",
        ("emerging_trend", 45.0), ("brand_risk", 0.0), ("source_freshness", 90.0),
        ("emerging_trend", None),
    )
    states = [r.alert_state for r in quality.evaluate_alerts(values).collect()]
    assert states == ["TRIGGERED", "OK", "OK", "OK"]


def test_failed_gate_names_its_checks(rows):
    checks = rows(
        "check_name STRING, passed BOOLEAN, detail STRING", ("a", True, "x"), ("b", False, "3 bad")
    )
    with pytest.raises(quality.QualityGateError, match="b: 3 bad"):
        quality.require_passing(checks)
    passing = checks.filter("passed")
    assert quality.require_passing(passing) is passing
