"""Decision loop: recommendations, approvals, experiments, learnings and scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.identity import is_blank, record_id, stable_decision_id, strip
from tidemark.functions.text import fill
from tidemark.operators.merge import merge_upsert, source, target
from tidemark.operators.rows import as_timestamp, top_per_group

# The seven-state recommendation lifecycle.
TRANSITIONS = {
    "PROPOSED": ("APPROVED", "REJECTED"),
    "APPROVED": ("EXPERIMENT_PLANNED", "REJECTED"),
    "EXPERIMENT_PLANNED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("COMPLETED", "CANCELLED"),
    "COMPLETED": (),
    "REJECTED": (),
    "CANCELLED": (),
}
# Experiment state -> recommendation state.
STATUS_OF_EXPERIMENT = {
    "PLANNED": "EXPERIMENT_PLANNED",
    "RUNNING": "RUNNING",
    "COMPLETED": "COMPLETED",
    "CANCELLED": "CANCELLED",
}
# Texts and settings of generated records; {} marks inserted values.
DEFEND_HYPOTHESIS = (
    "Addressing {} with evidence-led guidance will reduce negative conversation."
)
GROW_HYPOTHESIS = (
    "A {}-aligned creative for {} will outperform the current control with the target audience."
)
DEFEND_BRIEF = (
    "Lead with the verified customer concern, the corrective action, and a measurable "
    "support path. Evidence: {}"
)
GROW_BRIEF = (
    "Build one control and one treatment around {}. Keep offer, audience, placement, and "
    "budget constant. Evidence: {}"
)
REUSABLE_INSIGHT = (
    "{} Outcome: {}. Reuse only for comparable product, audience, channel, and offer contexts."
)
DRAFT_HYPOTHESIS = "Promoting {} increases qualified demand."
DRAFT_BRIEF = "Create a brand-safe variant grounded in the observed signal."
CONTROL_DEFINITION = "Current best-performing eligible creative"
GUARDRAIL_METRIC = "contribution_margin"
TARGET_LIFT_PCT = 10.0
PROPOSAL_SCORE = 45.0
KNOWN_ARTIFACT_STATUSES = ("VALIDATED", "PROPOSED", "COMPLETED")


def _case(value: Column, mapping: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, result in mapping.items():
        out = out.when(value == key, F.lit(result))
    return out


# --- recommendations -----------------------------------------------------------------


def proposals(opportunities: DataFrame, as_of) -> DataFrame:
    """Proposed recommendations for open, material opportunities."""
    now = as_timestamp(as_of)
    defend = F.col("opportunity_type") == "DEFEND"

    def by_type(defending: Column, growing: Column) -> Column:
        return F.when(defend, defending).otherwise(growing)

    hypothesis = by_type(
        fill(DEFEND_HYPOTHESIS, "signal_key"),
        fill(GROW_HYPOTHESIS, "signal_key", "product_name"),
    )
    brief = by_type(
        fill(DEFEND_BRIEF, "evidence_ref"), fill(GROW_BRIEF, "signal_key", "evidence_ref")
    )
    return opportunities.filter(
        (F.col("status") == "OPEN") & (F.col("opportunity_score") >= PROPOSAL_SCORE)
    ).select(
        record_id(F.col("opportunity_id"), F.lit("recommendation-v1")).alias(
            "recommendation_id"
        ),
        "tenant_id",
        "opportunity_id",
        "product_id",
        by_type(F.lit("BRAND_RESPONSE"), F.lit("CREATIVE_TEST")).alias("action_type"),
        F.col("preferred_channel").alias("channel"),
        "target_audience",
        hypothesis.alias("hypothesis"),
        brief.alias("creative_brief"),
        by_type(F.lit("negative_share"), F.lit("conversion_rate")).alias("primary_metric"),
        "confidence_score",
        F.lit("PROPOSED").alias("status"),
        "evidence_ref",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def generate_recommendations(
    recommendations: DataFrame, opportunities: DataFrame, as_of
) -> DataFrame:
    """Insert new proposals and refresh untouched ones; decided rows stay as they are."""
    refreshed = (
        "channel",
        "target_audience",
        "hypothesis",
        "creative_brief",
        "primary_metric",
        "confidence_score",
        "evidence_ref",
        "updated_at",
    )
    return merge_upsert(
        recommendations,
        proposals(opportunities, as_of),
        ["recommendation_id"],
        when_matched={c: source(c) for c in refreshed},
        matched_condition=target("status") == "PROPOSED",
    )


def check_transitions(requests: DataFrame) -> DataFrame:
    """Add ``violation``: NULL when the requested change is allowed.

    ``requests`` has ``current_status`` and ``requested_status``; both are compared
    trimmed and upper-cased.
    """
    current = F.upper(strip(F.col("current_status")))
    wanted = F.upper(strip(F.col("requested_status")))
    known = F.coalesce(current.isin(*TRANSITIONS), F.lit(False))
    allowed = F.lit(False)
    for state, followers in TRANSITIONS.items():
        if followers:
            allowed = allowed | ((current == state) & wanted.isin(*followers))
    return requests.withColumn(
        "violation",
        F.when(~known, F.lit("unknown_status")).when(
            ~F.coalesce(allowed, F.lit(False)), F.lit("invalid_transition")
        ),
    )


def validate_transitions(requests: DataFrame) -> DataFrame:
    """Requested status changes that the lifecycle does not allow."""
    return check_transitions(requests).filter(F.col("violation").isNotNull())


def check_approvals(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approval requests with ``rejection`` (NULL when they may be applied).

    ``decisions`` has (recommendation_id, actor, reason). Only proposed recommendations
    with evidence can be approved, by a named actor for a stated reason.
    """
    facts = recommendations.select("recommendation_id", "status", "evidence_ref")
    return decisions.join(facts, "recommendation_id", "left").withColumn(
        "rejection",
        F.when(is_blank(F.col("actor")) | is_blank(F.col("reason")), F.lit("actor_and_reason"))
        .when(~F.col("status").eqNullSafe(F.lit("PROPOSED")), F.lit("not_proposed"))
        .when(is_blank(F.col("evidence_ref")), F.lit("no_evidence")),
    )


def apply_approvals(
    recommendations: DataFrame, decisions: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """(next recommendations snapshot, refused decisions)."""
    checked = check_approvals(recommendations, decisions)
    accepted = checked.filter(F.col("rejection").isNull()).select(
        "recommendation_id",
        strip(F.col("actor")).alias("actor"),
        strip(F.col("reason")).alias("reason"),
    )
    snapshot = merge_upsert(
        recommendations,
        accepted,
        ["recommendation_id"],
        when_matched={
            "status": F.lit("APPROVED"),
            "decided_by": source("actor"),
            "decision_reason": source("reason"),
            "updated_at": as_timestamp(as_of),
        },
        insert=False,
    )
    return snapshot, checked.filter(F.col("rejection").isNotNull())


# --- experiments ---------------------------------------------------------------------


def planned_experiments(recommendations: DataFrame, as_of) -> DataFrame:
    now = as_timestamp(as_of)
    return recommendations.filter(F.col("status") == "APPROVED").select(
        record_id(F.col("recommendation_id"), F.lit("experiment-v1")).alias("experiment_id"),
        "tenant_id",
        "recommendation_id",
        F.lit("PLANNED").alias("status"),
        "primary_metric",
        F.lit(GUARDRAIL_METRIC).alias("guardrail_metric"),
        F.lit(TARGET_LIFT_PCT).alias("target_lift_pct"),
        F.lit(CONTROL_DEFINITION).alias("control_definition"),
        F.col("creative_brief").alias("treatment_definition"),
        F.lit(0.0).alias("planned_budget"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def plan_experiments(experiments: DataFrame, recommendations: DataFrame, as_of) -> DataFrame:
    """Insert a planned experiment for every approved recommendation that has none."""
    return merge_upsert(
        experiments, planned_experiments(recommendations, as_of), ["experiment_id"]
    )


def experiment_gate(recommendations: DataFrame, approvals: DataFrame) -> DataFrame:
    """Experiment plans of recommendations with an approval, by stable id."""
    approved = approvals.filter(F.col("status") == "APPROVED").select("recommendation_id")
    named = recommendations.filter(~is_blank(F.col("recommendation_id")))
    return named.join(approved, "recommendation_id", "left_semi").select(
        stable_decision_id(F.col("recommendation_id"), F.lit("experiment-v1")).alias(
            "experiment_id"
        ),
        strip(F.col("recommendation_id")).alias("recommendation_id"),
        F.lit("EXPERIMENT_PLANNED").alias("status"),
        "primary_metric",
    )


def experiment_states(experiments: DataFrame) -> DataFrame:
    """Recommendation state implied by each recommendation's experiment."""
    return (
        experiments.filter(F.col("status").isin(*STATUS_OF_EXPERIMENT))
        .select(
            "recommendation_id",
            _case(F.col("status"), STATUS_OF_EXPERIMENT).alias("recommendation_status"),
        )
    )


def sync_recommendation_status(
    recommendations: DataFrame, experiments: DataFrame, as_of, strict: bool = False
) -> DataFrame:
    """Push experiment states back to their recommendations (update only).

    ``strict`` applies only changes that the lifecycle allows; by default the experiment
    wins whatever the recommendation's state is.
    """
    states = experiment_states(experiments)
    if strict:
        requests = recommendations.select(
            "recommendation_id", F.col("status").alias("current_status")
        ).join(
            states.withColumnRenamed("recommendation_status", "requested_status"),
            "recommendation_id",
        )
        states = (
            check_transitions(requests)
            .filter(F.col("violation").isNull())
            .select(
                "recommendation_id",
                F.col("requested_status").alias("recommendation_status"),
            )
        )
    return merge_upsert(
        recommendations,
        states,
        ["recommendation_id"],
        when_matched={
            "status": source("recommendation_status"),
            "updated_at": as_timestamp(as_of),
        },
        matched_condition=source("recommendation_status").isNotNull(),
        insert=False,
    )


# --- learnings and read models -------------------------------------------------------


def measured_learnings(
    experiments: DataFrame, recommendations: DataFrame, products: DataFrame, as_of
) -> DataFrame:
    """Outcome, lift and margin of completed experiments with both revenues."""
    control, treatment = F.col("control_revenue"), F.col("treatment_revenue")
    outcome = scoring.experiment_outcome(control, treatment)
    completed = experiments.filter(
        (F.col("status") == "COMPLETED") & control.isNotNull() & treatment.isNotNull()
    ).select(
        "experiment_id", "tenant_id", "recommendation_id", "control_revenue",
        "treatment_revenue", "actual_spend",
    )
    context = recommendations.select(
        "recommendation_id",
        F.col("tenant_id").alias("_owner"),
        "product_id",
        "hypothesis",
    )
    margins = products.select(
        F.col("tenant_id").alias("_owner"), "product_id", "gross_margin_rate"
    )
    return (
        completed.join(context, "recommendation_id", "inner")
        .join(margins, ["_owner", "product_id"], "left")
        .select(
            record_id(F.col("experiment_id"), F.lit("learning-v1")).alias("learning_id"),
            "tenant_id",
            "experiment_id",
            "recommendation_id",
            outcome.alias("outcome"),
            scoring.measured_lift_pct(control, treatment).alias("measured_lift_pct"),
            (treatment - control).alias("incremental_revenue"),
            scoring.contribution_margin(
                control, treatment, F.col("gross_margin_rate"), F.col("actual_spend")
            ).alias("contribution_margin"),
            F.lit("DIRECTIONAL").alias("confidence_level"),
            fill(REUSABLE_INSIGHT, "hypothesis", outcome).alias("reusable_insight"),
            as_timestamp(as_of).alias("recorded_at"),
            F.lit("decision-engine").alias("recorded_by"),
        )
    )


def record_learnings(
    learnings: DataFrame,
    experiments: DataFrame,
    recommendations: DataFrame,
    products: DataFrame,
    as_of,
) -> DataFrame:
    """Insert learnings of newly completed experiments; recorded ones never change."""
    return merge_upsert(
        learnings,
        measured_learnings(experiments, recommendations, products, as_of),
        ["learning_id"],
    )


def experiment_performance(
    experiments: DataFrame, recommendations: DataFrame, learnings: DataFrame
) -> DataFrame:
    """Experiments with their recommendation context and measured outcome."""
    context = recommendations.select(
        "recommendation_id", "opportunity_id", "product_id", "action_type", "channel"
    )
    outcomes = learnings.select(
        "experiment_id", "outcome", "measured_lift_pct", "incremental_revenue",
        "contribution_margin", "confidence_level",
    )
    return (
        experiments.join(context, "recommendation_id", "inner")
        .join(outcomes, "experiment_id", "left")
        .select(
            "tenant_id", "experiment_id", "recommendation_id", "opportunity_id",
            "product_id", "action_type", "channel", "status", "primary_metric",
            "target_lift_pct", "planned_budget", "actual_spend", "control_conversions",
            "treatment_conversions", "control_revenue", "treatment_revenue", "outcome",
            "measured_lift_pct", "incremental_revenue", "contribution_margin",
            "confidence_level", "start_at", "end_at", "updated_at",
        )
    )


def _percent(part: str, whole: str) -> Column:
    return F.when(
        F.col(whole) > 0, F.round(100.0 * F.col(part).cast("double") / F.col(whole), 2)
    ).otherwise(F.lit(0.0))


def pilot_scorecard(
    opportunities: DataFrame,
    recommendations: DataFrame,
    experiments: DataFrame,
    learnings: DataFrame,
    as_of,
) -> DataFrame:
    """Adoption, experiment velocity, win rate and impact per tenant with opportunities or recommendations.

    All tables are read once and meet in one aggregate per tenant; none is joined.
    """
    status, lift = F.col("status"), "measured_lift_pct"
    none = F.lit(None).cast("double")

    def rows(kind: str, df: DataFrame, state: str, *amounts: Column) -> DataFrame:
        values = [a.cast("double") for a in amounts] or [none, none, none]
        named = [v.alias(n) for v, n in zip(values, (lift, "incremental_revenue", "contribution_margin"))]
        return df.select("tenant_id", F.lit(kind).alias("kind"), F.col(state).alias("status"), *named)

    listed = [
        rows("opportunity", opportunities, "status"),
        rows("recommendation", recommendations, "status"),
        rows("experiment", experiments, "status"),
        rows(
            "learning", learnings, "outcome", F.col(lift), F.col("incremental_revenue"),
            F.col("contribution_margin"),
        ),
    ]

    def counted(kind: str, condition: Column | None = None) -> Column:
        own = F.col("kind") == kind
        return F.count_if(own if condition is None else own & condition)

    joined = reduce(DataFrame.unionByName, listed).groupBy("tenant_id").agg(
        counted("opportunity").alias("opportunities_detected"),
        counted("opportunity", status == "OPEN").alias("opportunities_open"),
        counted("opportunity", status == "NEEDS_MAPPING").alias("opportunities_needing_mapping"),
        counted("recommendation").alias("recommendations_total"),
        counted("recommendation", ~status.isin("PROPOSED", "REJECTED")).alias(
            "recommendations_adopted"
        ),
        counted("recommendation", status == "REJECTED").alias("recommendations_rejected"),
        counted("experiment").alias("experiments_total"),
        counted("experiment", status == "COMPLETED").alias("experiments_completed"),
        counted("learning").alias("learnings_total"),
        counted("learning", status == "WIN").alias("winning_experiments"),
        F.avg(lift).alias(f"avg_{lift}"),
        F.sum("incremental_revenue").alias("incremental_revenue"),
        F.sum("contribution_margin").alias("contribution_margin"),
    )
    known = (F.col("opportunities_detected") > 0) | (F.col("recommendations_total") > 0)
    joined = joined.filter(known)
    zero = ["incremental_revenue", "contribution_margin"]
    return joined.fillna(0, zero).select(
        "tenant_id",
        "opportunities_detected",
        "opportunities_open",
        "opportunities_needing_mapping",
        "recommendations_total",
        "recommendations_adopted",
        "recommendations_rejected",
        _percent("recommendations_adopted", "recommendations_total").alias(
            "recommendation_adoption_rate_pct"
        ),
        "experiments_total",
        "experiments_completed",
        "learnings_total",
        "winning_experiments",
        _percent("winning_experiments", "learnings_total").alias("experiment_win_rate_pct"),
        "avg_measured_lift_pct",
        "incremental_revenue",
        "contribution_margin",
        as_timestamp(as_of).alias("evaluated_at"),
    )


# --- drafts and artifact checks ------------------------------------------------------

_DRAFT_TEXTS = (
    "opportunity_id",
    "action_type",
    "channel",
    "hypothesis",
    "creative_brief",
    "primary_metric",
)


def draft_recommendation(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deterministic drafts, refused requests). Nothing is stored or approved.

    ``requests`` has tenant_id, the six texts, ``confidence_score`` and ``evidence_ids``.
    """
    cleaned = F.transform("evidence_ids", strip)
    evidence = F.array_sort(
        F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (F.length(x) > 0)))
    )
    checks = [(f"missing_{c}", is_blank(F.col(c))) for c in _DRAFT_TEXTS]
    checks += [
        (
            "confidence_out_of_range",
            ~F.coalesce(F.col("confidence_score").between(0, 100), F.lit(False)),
        ),
        ("no_evidence", F.coalesce(F.size(evidence), F.lit(0)) <= 0),
    ]
    checked = requests.withColumn(
        "refusal", F.concat_ws(",", *[F.when(c, F.lit(label)) for label, c in checks])
    )
    drafts = checked.filter("refusal = ''").select(
        stable_decision_id(
            F.col("tenant_id"), F.col("opportunity_id"), F.lit("recommendation-v1")
        ).alias("recommendation_id"),
        F.lit("1.0").alias("schema_version"),
        "tenant_id",
        *_DRAFT_TEXTS,
        "confidence_score",
        F.lit("PROPOSED").alias("status"),
        evidence.alias("evidence_ids"),
        F.lit("none").alias("mutation"),
        F.lit(True).alias("approval_required"),
    )
    return drafts, checked.filter("refusal <> ''")


def evidence_gated_draft(opportunities: DataFrame, task: str, limit: int = 5) -> DataFrame:
    """Per tenant: a draft for the best opportunity when the top ones carry evidence.

    ``opportunities`` has (tenant_id, opportunity_id, opportunity_score, signal_ts,
    topic, evidence_ids). Only the top ``limit`` rows of a tenant reach its reducer, and
    the evidence union is over those rows alone.
    """
    top = top_per_group(
        opportunities,
        ["tenant_id"],
        [F.desc("opportunity_score"), F.desc("signal_ts"), F.desc("opportunity_id")],
        limit,
    )
    best = F.struct("opportunity_id", "opportunity_score", "topic")
    per_tenant = top.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("opportunities_considered"),
        F.min_by(best, "_rank").alias("selected"),
        F.array_sort(
            F.array_distinct(
                F.filter(F.flatten(F.collect_list("evidence_ids")), lambda x: x != "")
            )
        ).alias("evidence_ids"),
    )
    evidenced = F.size("evidence_ids") > 0
    chosen = F.col("selected")
    subject = F.coalesce(chosen["topic"], chosen["opportunity_id"])
    run_id = stable_decision_id(F.col("tenant_id"), F.lit(task), F.lit("agent-run-v1"))
    draft = F.struct(
        stable_decision_id(
            F.col("tenant_id"), chosen["opportunity_id"], F.lit("recommendation-v1")
        ).alias("recommendation_id"),
        chosen["opportunity_id"].alias("opportunity_id"),
        F.lit("PROMOTE").alias("action_type"),
        F.lit("PAID_SOCIAL").alias("channel"),
        fill(DRAFT_HYPOTHESIS, subject).alias("hypothesis"),
        F.lit(DRAFT_BRIEF).alias("creative_brief"),
        F.lit("conversion_rate").alias("primary_metric"),
        chosen["opportunity_score"].alias("confidence_score"),
    )
    return per_tenant.select(
        run_id.alias("run_id"),
        "tenant_id",
        F.when(evidenced, F.lit("PROPOSED")).otherwise(F.lit("BLOCKED")).alias("status"),
        F.lit(True).alias("approval_required"),
        "opportunities_considered",
        "evidence_ids",
        F.when(evidenced, draft).alias("recommendation"),
    )


def evaluate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Identity, evidence and status checks of produced artifacts, PASS or FAIL each."""
    identity = (F.coalesce(F.length("artifact_id"), F.lit(0)) > 0) & (
        F.coalesce(F.length("run_id"), F.lit(0)) > 0
    )
    evidence = F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0
    known = F.coalesce(F.col("status").isin(*KNOWN_ARTIFACT_STATUSES), F.lit(False))
    passed = F.col("has_identity") & F.col("has_evidence") & F.col("known_status")
    return artifacts.withColumns(
        {"has_identity": identity, "has_evidence": evidence, "known_status": known}
    ).withColumn("evaluation", F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")))
