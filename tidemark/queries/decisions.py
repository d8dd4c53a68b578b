"""Merges, the decision loop, checks and alerts.

Fixed values in the SQL below: check names, states and generated texts that the results must match.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scoring
from tidemark.operators import control, lifecycle, metrics, quality
from tidemark.operators.envelope import dead_letter
from tidemark.operators.signals import latest_brand_day
from tidemark.queries import tables as t
from tidemark.queries.delivery import health, operations
from tidemark.queries.facts import opportunity_table
from tidemark.queries.oracles import six
from tidemark.queries.registry import query
from tidemark.queries.stored import Stored


# --- control tables ------------------------------------------------------------------


def _sources(spark, folder):
    """A registered source per customer."""
    key = F.col("c_custkey")
    return t.load(spark, folder, "customer").select(
        F.concat(F.lit("t"), key % 3).alias("tenant_id"),
        F.concat(F.lit("src-"), key).alias("source_id"),
        F.col("c_mktsegment").alias("platform"),
        F.lit("demo").alias("connector_type"),
        F.lit("polling").alias("collection_mode"),
        (key % 2 == 0).alias("enabled"),
        F.lit("1.0").alias("event_schema_version"),
        F.lit(300).alias("poll_interval_seconds"),
        F.lit("scope").alias("secret_scope"),
        F.concat(F.lit("key-"), key).alias("secret_key"),
        F.col("c_name").alias("owner"),
        F.lit(t.AS_OF).alias("updated_at"),
    )


@query(
    "upsert_sources",
    """SELECT 't' || (c_custkey % 3) AS tenant_id, 'src-' || c_custkey AS source_id,
      CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE 'orders' END AS platform,
      CASE WHEN o_custkey IS NULL THEN c_custkey % 2 = 0 ELSE true END AS enabled,
      'key-' || c_custkey AS secret_key
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""",
)
def upsert_sources(spark, folder):
    """Every ordering customer re-registers as an enabled source; secrets stay stored."""
    key = F.col("o_custkey")
    incoming = t.load(spark, folder, "orders").select("o_custkey").distinct().select(
        F.concat(F.lit("t"), key % 3).alias("tenant_id"),
        F.concat(F.lit("src-"), key).alias("source_id"),
        F.lit("orders").alias("platform"),
        F.lit("demo").alias("connector_type"),
        F.lit("polling").alias("collection_mode"),
        F.lit(True).alias("enabled"),
        F.lit("1.0").alias("event_schema_version"),
        F.lit(900).alias("poll_interval_seconds"),
        F.lit(None).cast("string").alias("secret_scope"),
        F.lit(None).cast("string").alias("secret_key"),
        F.lit("orders").alias("owner"),
        F.lit(t.AS_OF).alias("updated_at"),
    )
    merged = control.upsert_sources(_sources(spark, folder), incoming, keep_secrets=True)
    return merged.select("tenant_id", "source_id", "platform", "enabled", "secret_key")


_RULES_AT = datetime(2024, 1, 1)


@query(
    "rules_upsert",
    """SELECT tenant_id, rule_id, source_id,
      CASE WHEN incoming THEN 'new' ELSE 'old' END AS expression,
      CASE WHEN incoming THEN true ELSE NOT (tenant_id = 't0' AND source_id = 'src-1') END
        AS enabled,
      CASE WHEN incoming OR (tenant_id = 't0' AND source_id = 'src-1')
        THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS updated_at
    FROM (SELECT 't' || (p_partkey % 3) AS tenant_id, 'rule-' || p_partkey AS rule_id,
        'src-' || (p_partkey % 4) AS source_id,
        p_size > 25 AND p_partkey % 3 = 0 AND p_partkey % 4 = 1 AS incoming
      FROM part)""",
)
def rules_upsert(spark, folder):
    """A rule per part; the incoming set of source t0/src-1 keeps its large parts only."""
    key = F.col("p_partkey")
    parts = t.load(spark, folder, "part")

    def rules(df, expression, at):
        return df.select(
            F.concat(F.lit("t"), key % 3).alias("tenant_id"),
            F.concat(F.lit("rule-"), key).alias("rule_id"),
            F.concat(F.lit("src-"), key % 4).alias("source_id"),
            F.lit("keyword").alias("rule_type"),
            F.lit(expression).alias("expression"),
            F.lit(True).alias("enabled"),
            F.lit(at).alias("updated_at"),
        )

    old = rules(parts, "old", _RULES_AT)
    own = (F.col("tenant_id") == "t0") & (F.col("source_id") == "src-1")
    incoming = rules(parts.filter("p_size > 25"), "new", t.AS_OF).filter(own)
    merged = control.upsert_rules(old, incoming, t.AS_OF, tenant_id="t0", source_id="src-1")
    return t.plain(merged.drop("rule_type"))


@query(
    "upsert_contracts",
    """SELECT coalesce(o.v, n.v) AS schema_version, coalesce(o.k, n.k) AS event_type,
      CASE WHEN n.k IS NULL THEN 'NONE' ELSE 'BACKWARD' END AS compatibility_mode,
      n.k IS NOT NULL AS active,
      CASE WHEN o.k IS NULL THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END
        AS registered_at
    FROM (SELECT DISTINCT '1.0' AS v, event_type AS k FROM events WHERE event_type <> 'view') o
    FULL JOIN (SELECT DISTINCT '1.0' AS v, event_type AS k FROM events
      WHERE event_type <> 'error') n ON o.v = n.v AND o.k = n.k""",
)
def upsert_contracts(spark, folder):
    """Contracts of the event types: one is new, one is no longer offered, one time stays."""
    kinds = t.load(spark, folder, "events").select("event_type").distinct()

    def contracts(df, mode, active, at):
        return df.select(
            F.lit("1.0").alias("schema_version"),
            "event_type",
            F.lit(mode).alias("compatibility_mode"),
            F.lit("SOURCE_SHAPED_JSON").alias("payload_policy"),
            F.lit(active).alias("active"),
            F.lit(at).alias("registered_at"),
        )

    old = contracts(kinds.filter("event_type <> 'view'"), "NONE", False, _RULES_AT)
    new = contracts(kinds.filter("event_type <> 'error'"), "BACKWARD", True, t.AS_OF)
    return t.plain(control.upsert_contracts(old, new).drop("payload_policy"))


@query(
    "upsert_products",
    """SELECT 't' || (p_partkey % 3) AS tenant_id, CAST(p_partkey AS VARCHAR) AS product_id,
      p_name AS product_name, CASE WHEN sold THEN 'sold' ELSE p_type END AS category,
      CASE WHEN sold THEN 0.5::DOUBLE ELSE p_size / 100.0::DOUBLE END AS gross_margin_rate
    FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
      AND l_returnflag = 'R' AND l_quantity > 45) AS sold FROM part)""",
)
def upsert_products(spark, folder):
    """Parts returned in bulk get a new category and margin."""
    catalog = t.products(spark, folder)
    returned = (
        t.load(spark, folder, "lineitem")
        .filter("l_returnflag = 'R' AND l_quantity > 45")
        .select(F.col("l_partkey").cast("string").alias("product_id"))
    )
    incoming = catalog.join(returned, "product_id", "left_semi").withColumns(
        {"category": F.lit("sold"), "gross_margin_rate": F.lit(0.5)}
    )
    return t.plain(
        control.upsert_products(catalog, incoming).drop("active", "updated_at")
    )


@query(
    "upsert_signal_map",
    """SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id,
      coalesce(o.signal_key, n.signal_key) AS signal_key,
      coalesce(n.product_fit, o.product_fit) AS product_fit
    FROM (SELECT 't' || (p_partkey % 3) AS tenant_id, 'part-' || p_partkey AS signal_key,
        0.2::DOUBLE AS product_fit FROM part WHERE p_size < 30) o
    FULL JOIN (SELECT 't' || (p_partkey % 3) AS tenant_id, 'part-' || p_partkey AS signal_key,
        0.9::DOUBLE AS product_fit FROM part WHERE p_size > 20) n USING (tenant_id, signal_key)""",
)
def upsert_signal_map(spark, folder):
    """Maps of small parts, merged with maps of larger parts (they overlap)."""
    key = F.col("p_partkey")

    def maps(df, fit):
        return df.select(
            F.concat(F.lit("t"), key % 3).alias("tenant_id"),
            F.concat(F.lit("part-"), key).alias("signal_key"),
            key.cast("string").alias("product_id"),
            F.lit(fit).alias("product_fit"),
            F.lit(0.5).alias("commercial_fit"),
            F.lit("shoppers").alias("target_audience"),
            F.lit("paid-social").alias("preferred_channel"),
            F.lit(True).alias("active"),
            F.lit(t.AS_OF).alias("updated_at"),
        )

    parts = t.load(spark, folder, "part")
    merged = control.upsert_signal_map(
        maps(parts.filter("p_size < 30"), 0.2), maps(parts.filter("p_size > 20"), 0.9)
    )
    return merged.select("tenant_id", "signal_key", "product_fit")


# --- decision loop -------------------------------------------------------------------


@query(
    "proposals",
    """SELECT sha256(opportunity_id || '|recommendation-v1') AS recommendation_id, tenant_id,
      opportunity_id, product_id,
      CASE opportunity_type WHEN 'DEFEND' THEN 'BRAND_RESPONSE' ELSE 'CREATIVE_TEST' END
        AS action_type,
      preferred_channel AS channel, target_audience,
      CASE opportunity_type WHEN 'DEFEND' THEN 'negative_share' ELSE 'conversion_rate' END
        AS primary_metric,
      CASE opportunity_type WHEN 'DEFEND' THEN 'Addressing ' || signal_key
          || ' with evidence-led guidance will reduce negative conversation.'
        ELSE 'A ' || signal_key || '-aligned creative for ' || product_name
          || ' will outperform the current control with the target audience.' END AS hypothesis,
      CASE opportunity_type WHEN 'DEFEND' THEN 'Lead with the verified customer concern, the '
          || 'corrective action, and a measurable support path. Evidence: ' || evidence_ref
        ELSE 'Build one control and one treatment around ' || signal_key || '. Keep offer, '
          || 'audience, placement, and budget constant. Evidence: ' || evidence_ref END
        AS creative_brief,
      confidence_score, 'PROPOSED' AS status
    FROM opportunities_v WHERE status = 'OPEN' AND opportunity_score >= 45""",
)
def proposals(spark, folder):
    rows = lifecycle.proposals(opportunity_table(spark, folder), t.AS_OF)
    return rows.select(
        "recommendation_id", "tenant_id", "opportunity_id", "product_id", "action_type",
        "channel", "target_audience", "primary_metric", "hypothesis", "creative_brief",
        "confidence_score", "status",
    )


def _part_opportunities(spark, folder):
    """An open opportunity per part, for merges of real size."""
    key = F.col("p_partkey")
    return t.load(spark, folder, "part").select(
        F.concat(F.lit("opp-"), key).alias("opportunity_id"),
        F.concat(F.lit("t"), key % 3).alias("tenant_id"),
        F.when(key % 4 == 0, F.lit("DEFEND")).otherwise(F.lit("GROW")).alias("opportunity_type"),
        F.col("p_type").alias("signal_key"),
        key.cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.lit("owned-social").alias("preferred_channel"),
        F.lit("everyone").alias("target_audience"),
        F.lit("OPEN").alias("status"),
        (F.col("p_size") * 2).cast("double").alias("opportunity_score"),
        F.col("p_size").cast("double").alias("confidence_score"),
        F.concat(F.lit("part:"), key).alias("evidence_ref"),
    )


@query(
    "recommendations_merge",
    """SELECT coalesce(o.rid, n.rid) AS recommendation_id,
      coalesce(o.tenant_id, n.tenant_id) AS tenant_id,
      CASE WHEN o.rid IS NULL OR (n.rid IS NOT NULL AND o.status = 'PROPOSED')
        THEN 'owned-social' ELSE 'paid-social' END AS channel,
      CASE WHEN o.rid IS NULL THEN n.confidence
        WHEN n.rid IS NOT NULL AND o.status = 'PROPOSED' THEN n.confidence
        ELSE o.confidence END AS confidence_score,
      coalesce(o.status, 'PROPOSED') AS status,
      CASE WHEN o.rid IS NULL OR (n.rid IS NOT NULL AND o.status = 'PROPOSED')
        THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-15' END AS updated_at,
      coalesce(o.hypothesis_kept AND NOT (n.rid IS NOT NULL AND o.status = 'PROPOSED'), false)
        AS hypothesis_kept
    FROM (SELECT sha256('opp-' || product_id || '|recommendation-v1') AS rid, tenant_id, status,
        confidence_score AS confidence, true AS hypothesis_kept FROM recommendations_v
        WHERE status <> 'CANCELLED') o
    FULL JOIN (SELECT sha256('opp-' || p_partkey || '|recommendation-v1') AS rid,
        't' || (p_partkey % 3) AS tenant_id, p_size::DOUBLE AS confidence
      FROM part WHERE p_size * 2 >= 45) n USING (rid)""",
)
def recommendations_merge(spark, folder):
    """Stored recommendations (none of the cancelled ones) meet fresh proposals."""
    from tidemark.functions.identity import record_id

    stored = (
        t.recommendations(spark, folder)
        .filter("status <> 'CANCELLED'")
        .withColumn(
            "recommendation_id", record_id(F.col("opportunity_id"), F.lit("recommendation-v1"))
        )
    )
    merged = lifecycle.generate_recommendations(
        stored, _part_opportunities(spark, folder), t.AS_OF
    )
    return t.plain(
        merged.select(
            "recommendation_id", "tenant_id", "channel", "confidence_score", "status",
            "updated_at",
            F.col("hypothesis").startswith("Promote ").alias("hypothesis_kept"),
        )
    )


def _stored_experiments(spark, folder):
    return t.experiments(spark, folder).filter("status <> 'DRAFT'")


@query(
    "experiments_plan",
    """SELECT experiment_id, tenant_id, recommendation_id, status, control_revenue,
      TIMESTAMP '2024-01-20' AS created_at FROM experiments_v WHERE status <> 'DRAFT'
    UNION ALL
    SELECT sha256(recommendation_id || '|experiment-v1'), tenant_id, recommendation_id,
      'PLANNED', NULL, TIMESTAMP '2024-01-31'
    FROM recommendations_v WHERE status = 'APPROVED'
      AND sha256(recommendation_id || '|experiment-v1')
        NOT IN (SELECT experiment_id FROM experiments_v WHERE status <> 'DRAFT')""",
)
def experiments_plan(spark, folder):
    planned = lifecycle.plan_experiments(
        _stored_experiments(spark, folder), t.recommendations(spark, folder), t.AS_OF
    )
    return t.plain(
        planned.select(
            "experiment_id", "tenant_id", "recommendation_id", "status", "control_revenue",
            "created_at",
        )
    )


_STATE = """CASE e.status WHEN 'PLANNED' THEN 'EXPERIMENT_PLANNED' ELSE e.status END"""


@query(
    "status_sync",
    f"""SELECT r.recommendation_id, CASE WHEN e.status IN
        ('PLANNED', 'RUNNING', 'COMPLETED', 'CANCELLED') THEN {_STATE} ELSE r.status END AS status,
      CASE WHEN e.status IN ('PLANNED', 'RUNNING', 'COMPLETED', 'CANCELLED')
        THEN TIMESTAMP '2024-01-31' ELSE r.updated_at END AS updated_at
    FROM recommendations_v r LEFT JOIN experiments_v e USING (recommendation_id)""",
)
def status_sync(spark, folder):
    synced = lifecycle.sync_recommendation_status(
        t.recommendations(spark, folder), t.experiments(spark, folder), t.AS_OF
    )
    return t.plain(synced.select("recommendation_id", "status", "updated_at"))


_EDGES = """(VALUES ('PROPOSED', 'APPROVED'), ('PROPOSED', 'REJECTED'),
  ('APPROVED', 'EXPERIMENT_PLANNED'), ('APPROVED', 'REJECTED'),
  ('EXPERIMENT_PLANNED', 'RUNNING'), ('EXPERIMENT_PLANNED', 'CANCELLED'),
  ('RUNNING', 'COMPLETED'), ('RUNNING', 'CANCELLED')) g(a, b)"""


@query(
    "status_sync_strict",
    f"""SELECT r.recommendation_id, CASE WHEN g.a IS NOT NULL THEN {_STATE} ELSE r.status END
      AS status
    FROM recommendations_v r LEFT JOIN experiments_v e USING (recommendation_id)
    LEFT JOIN {_EDGES} ON g.a = r.status AND g.b = {_STATE}""",
)
def status_sync_strict(spark, folder):
    synced = lifecycle.sync_recommendation_status(
        t.recommendations(spark, folder), t.experiments(spark, folder), t.AS_OF, strict=True
    )
    return synced.select("recommendation_id", "status")


def _learnings(spark, folder):
    return lifecycle.measured_learnings(
        t.experiments(spark, folder, completed=True),
        t.recommendations(spark, folder),
        t.products(spark, folder),
        t.AS_OF,
    )


@query(
    "learnings",
    """SELECT learning_id, tenant_id, experiment_id, outcome, measured_lift_pct,
      incremental_revenue, contribution_margin, hypothesis || ' Outcome: ' || outcome
        || '. Reuse only for comparable product, audience, channel, and offer contexts.'
        AS reusable_insight
    FROM learnings_v""",
)
def learnings(spark, folder):
    """Learnings recorded into a table that already holds the losses."""
    stored = _learnings(spark, folder).filter("outcome = 'LOSS'")
    merged = lifecycle.record_learnings(
        stored,
        t.experiments(spark, folder, completed=True),
        t.recommendations(spark, folder),
        t.products(spark, folder),
        t.AS_OF,
    )
    return merged.select(
        "learning_id", "tenant_id", "experiment_id", "outcome", "measured_lift_pct",
        "incremental_revenue", "contribution_margin", "reusable_insight",
    )


@query(
    "experiment_result",
    """SELECT recommendation_id,
      CASE WHEN control_revenue > 0 THEN round(100 * (treatment_revenue - control_revenue)
        / control_revenue, 2) END AS measured_lift_pct,
      treatment_revenue - control_revenue AS incremental_revenue,
      round((treatment_revenue - control_revenue) * 0.5 - actual_spend, 2)
        AS contribution_margin
    FROM experiments_v""",
)
def experiment_result(spark, folder):
    result = scoring.experiment_result(
        F.col("control_revenue"), F.col("treatment_revenue"), F.col("actual_spend"), F.lit(0.5)
    )
    return (
        t.experiments(spark, folder)
        .select("recommendation_id", result.alias("r"))
        .filter("r.valid")
        .select(
            "recommendation_id", "r.measured_lift_pct", "r.incremental_revenue",
            "r.contribution_margin",
        )
    )


def performance(spark, folder):
    """Experiments whose wins are recorded already."""
    return lifecycle.experiment_performance(
        t.experiments(spark, folder),
        t.recommendations(spark, folder),
        _learnings(spark, folder).filter("outcome = 'WIN'"),
    )


@query(
    "experiment_performance",
    """SELECT tenant_id, experiment_id, recommendation_id, opportunity_id, product_id, status,
      control_revenue, treatment_revenue, outcome, measured_lift_pct, contribution_margin
    FROM performance_v""",
)
def experiment_performance(spark, folder):
    return performance(spark, folder).select(
        "tenant_id", "experiment_id", "recommendation_id", "opportunity_id", "product_id",
        "status", "control_revenue", "treatment_revenue", "outcome", "measured_lift_pct",
        "contribution_margin",
    )


def scorecard(spark, folder):
    """Scorecard with the margin in whole units: a sum of fractions depends on its order."""
    card = lifecycle.pilot_scorecard(
        opportunity_table(spark, folder),
        t.recommendations(spark, folder),
        t.experiments(spark, folder),
        _learnings(spark, folder),
        t.AS_OF,
    )
    return card.withColumn("contribution_margin", F.round("contribution_margin", 0))


@query("pilot_scorecard", "SELECT * FROM scorecard_v")
def pilot_scorecard(spark, folder):
    return t.plain(scorecard(spark, folder))


_REQUESTED = """CASE p_partkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN ' RUNNING '
  WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'EXPERIMENT_PLANNED' ELSE 'ARCHIVED' END"""


def _requests(spark, folder):
    key = F.col("product_id").cast("bigint") % 5
    wanted = F.lit("ARCHIVED")
    for i, state in enumerate(("approved", " RUNNING ", "COMPLETED", "EXPERIMENT_PLANNED")):
        wanted = F.when(key == i, F.lit(state)).otherwise(wanted)
    return t.recommendations(spark, folder).select(
        "recommendation_id",
        F.col("status").alias("current_status"),
        wanted.alias("requested_status"),
    )


@query(
    "transition_violations",
    f"""SELECT recommendation_id, status AS current_status, requested AS requested_status,
      'invalid_transition' AS violation
    FROM recommendations_v
    JOIN (SELECT CAST(p_partkey AS VARCHAR) AS product_id, {_REQUESTED} AS requested
      FROM part) USING (product_id)
    WHERE NOT EXISTS (SELECT 1 FROM {_EDGES} WHERE a = status AND b = upper(trim(requested)))""",
)
def transition_violations(spark, folder):
    return lifecycle.validate_transitions(_requests(spark, folder))


def _decisions(spark, folder):
    key = F.col("p_partkey")
    return t.load(spark, folder, "part").select(
        F.concat(F.lit("rec-"), key).alias("recommendation_id"),
        F.when(F.col("p_size") > 5, F.lit(" owner ")).otherwise(F.lit(" ")).alias("actor"),
        F.lit("reviewed evidence").alias("reason"),
    )


@query(
    "approvals",
    """SELECT recommendation_id,
      CASE WHEN ok THEN 'APPROVED' ELSE status END AS status,
      CASE WHEN ok THEN 'owner' END AS decided_by,
      CASE WHEN ok THEN 'reviewed evidence' END AS decision_reason
    FROM (SELECT *, status = 'PROPOSED' AND evidence_ref <> '' AND confidence_score > 10 AS ok
      FROM recommendations_v)""",
)
def approvals(spark, folder):
    snapshot, _ = lifecycle.apply_approvals(
        t.recommendations(spark, folder), _decisions(spark, folder), t.AS_OF
    )
    return snapshot.select("recommendation_id", "status", "decided_by", "decision_reason")


@query(
    "approval_refusals",
    """SELECT recommendation_id, CASE WHEN confidence_score <= 10 THEN 'actor_and_reason'
      WHEN status <> 'PROPOSED' THEN 'not_proposed' ELSE 'no_evidence' END AS rejection
    FROM recommendations_v
    WHERE NOT (status = 'PROPOSED' AND evidence_ref <> '' AND confidence_score > 10)""",
)
def approval_refusals(spark, folder):
    _, refused = lifecycle.apply_approvals(
        t.recommendations(spark, folder), _decisions(spark, folder), t.AS_OF
    )
    return refused.select("recommendation_id", "rejection")


@query(
    "experiment_gate",
    """SELECT sha256(recommendation_id || '|experiment-v1') AS experiment_id,
      recommendation_id, 'EXPERIMENT_PLANNED' AS status FROM recommendations_v
    WHERE status = 'APPROVED'""",
)
def experiment_gate(spark, folder):
    recommendations = t.recommendations(spark, folder)
    plans = lifecycle.experiment_gate(recommendations, recommendations)
    return plans.select("experiment_id", "recommendation_id", "status")


def _draft_requests(spark, folder):
    key = F.col("p_partkey")
    return t.load(spark, folder, "part").select(
        F.concat(F.lit("t"), key % 3).alias("tenant_id"),
        F.concat(F.lit("Opp-"), key).alias("opportunity_id"),
        F.lit("CREATIVE_TEST").alias("action_type"),
        F.lit("paid-social").alias("channel"),
        F.col("p_name").alias("hypothesis"),
        F.lit("Show it").alias("creative_brief"),
        F.lit("conversion_rate").alias("primary_metric"),
        (F.col("p_size") * 2.5).alias("confidence_score"),
        F.array(
            F.col("p_brand"), F.lit(" ev-1 "), F.lit("ev-1"), F.lit(""), F.lit(None)
        ).alias("evidence_ids"),
    )


@query(
    "draft_recommendation",
    """SELECT sha256('t' || (p_partkey % 3) || '|opp-' || p_partkey || '|recommendation-v1')
        AS recommendation_id, 't' || (p_partkey % 3) AS tenant_id,
      'Opp-' || p_partkey AS opportunity_id, (p_size * 2.5)::DOUBLE AS confidence_score,
      p_brand || ',ev-1' AS evidence_ids, 'PROPOSED' AS status, true AS approval_required
    FROM part WHERE p_size * 2.5 <= 100""",
)
def draft_recommendation(spark, folder):
    """Parts as draft requests; a size above 40 asks for more than 100 percent."""
    drafts, _ = lifecycle.draft_recommendation(_draft_requests(spark, folder))
    return t.plain(
        drafts.select(
            "recommendation_id", "tenant_id", "opportunity_id", "confidence_score",
            "evidence_ids", "status", "approval_required",
        )
    )


def part_opportunities(spark, folder):
    """Scored opportunities of parts with evidence ids; tenant t2 has no evidence."""
    key = F.col("p_partkey")
    return t.load(spark, folder, "part").select(
        F.concat(F.lit("t"), key % 3).alias("tenant_id"),
        F.concat(F.lit("opp-"), key).alias("opportunity_id"),
        F.col("p_retailprice").alias("_price"),
        (F.col("p_size") * 2).cast("double").alias("opportunity_score"),
        F.lit(t.AS_OF).alias("signal_ts"),
        F.col("p_name").alias("topic"),
        F.when(F.col("p_size") % 2 == 0, F.lit("OPEN")).otherwise(F.lit("WATCH")).alias("status"),
        F.when(key % 3 == 2, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("ev-"), key % 10), F.concat(F.lit("ev-"), key % 4)))
        .alias("evidence_ids"),
    )


@query(
    "evidence_gated_draft",
    """WITH best AS (
      SELECT *, row_number() OVER (PARTITION BY p_partkey % 3
        ORDER BY p_size DESC, 'opp-' || p_partkey DESC) AS rank FROM part
      QUALIFY rank <= 5)
    SELECT 't' || (p_partkey % 3) AS tenant_id,
      CASE WHEN p_partkey % 3 = 2 THEN 'BLOCKED' ELSE 'PROPOSED' END AS status,
      (SELECT count(*) FROM best b WHERE b.p_partkey % 3 = best.p_partkey % 3)
        AS opportunities_considered,
      coalesce((SELECT string_agg(DISTINCT ev, ',' ORDER BY ev) FROM (
        SELECT p_partkey, 'ev-' || (p_partkey % 10) AS ev FROM best
        UNION ALL SELECT p_partkey, 'ev-' || (p_partkey % 4) FROM best) x
        WHERE x.p_partkey % 3 = best.p_partkey % 3 AND x.p_partkey % 3 <> 2), '')
        AS evidence_ids,
      CASE WHEN p_partkey % 3 <> 2 THEN 'opp-' || p_partkey END AS opportunity_id,
      CASE WHEN p_partkey % 3 <> 2 THEN 'Promoting ' || p_name
        || ' increases qualified demand.' END AS hypothesis,
      CASE WHEN p_partkey % 3 <> 2 THEN (p_size * 2)::DOUBLE END AS confidence_score
    FROM best WHERE rank = 1""",
)
def evidence_gated_draft(spark, folder):
    drafts = lifecycle.evidence_gated_draft(part_opportunities(spark, folder), "promote")
    return t.plain(
        drafts.select(
            "tenant_id", "status", "opportunities_considered", "evidence_ids",
            "recommendation.opportunity_id", "recommendation.hypothesis",
            "recommendation.confidence_score",
        )
    )


@query(
    "evaluate_artifacts",
    """SELECT p_partkey, p_partkey % 7 <> 0 AS has_identity, p_partkey % 3 <> 2 AS has_evidence,
      p_size % 2 = 0 AS known_status,
      CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 2 AND p_size % 2 = 0 THEN 'PASS'
        ELSE 'FAIL' END AS evaluation
    FROM part""",
)
def evaluate_artifacts(spark, folder):
    key = F.col("p_partkey")
    artifacts = t.load(spark, folder, "part").select(
        "p_partkey",
        F.when(key % 7 != 0, F.concat(F.lit("a-"), key)).alias("artifact_id"),
        F.lit("run").alias("run_id"),
        F.when(key % 3 != 2, F.array(F.lit("ev-1"))).alias("evidence_ids"),
        F.when(F.col("p_size") % 2 == 0, F.lit("VALIDATED"))
        .otherwise(F.lit("draft"))
        .alias("status"),
    )
    rows = lifecycle.evaluate_artifacts(artifacts)
    return rows.select(
        "p_partkey", "has_identity", "has_evidence", "known_status", "evaluation"
    )


# --- checks and alerts ---------------------------------------------------------------


def _product_tables(spark, folder) -> Stored:
    """Tables that several others rest on are stored, and those whose counts are observed instead of scanned."""
    kept = (
        "silver_social_posts", "gold_trend_hourly", "gold_trend_snapshot", "gold_challenge_snapshot",
        "gold_brand_daily", "decision_recommendations",
    )
    return Stored(spark, folder, kept, {
        "gold_opportunities": lambda m: _part_opportunities(spark, folder),
        "decision_recommendations": lambda m: t.recommendations(spark, folder),
        "decision_experiments": lambda m: t.experiments(spark, folder),
        "gold_connector_operations": lambda m: operations(spark, folder),
    })


def _one(name: str, passed: str, detail: str, source: str) -> str:
    return f"SELECT '{name}' AS check_name, {passed} AS passed, {detail} AS detail FROM {source}"


# Recommendations beside the opportunity that they name.
_LINEAGE = """recommendations_v r LEFT JOIN (SELECT 'opp-' || p_partkey AS parent FROM part) o
  ON o.parent = r.opportunity_id"""
_BAD_LINEAGE = "count(*) FILTER (o.parent IS NULL OR r.evidence_ref IS NULL)"

_PRODUCT_CHECKS = "\nUNION ALL ".join(
    [
        _one(
            "registered_sources_are_available", "count(*) > 0",
            "count(*) || ' enabled sources'", "registry_v WHERE enabled",
        ),
        _one(
            "raw_events_have_required_envelope", "count(*) = 0",
            "count(*) || ' invalid envelopes'",
            "deliveries_v WHERE tenant_id IS NULL OR idempotency_key IS NULL "
            "OR payload IS NULL",
        ),
        _one(
            "dead_letter_queue_is_empty", "count(*) = 0", "count(*) || ' rejected events'",
            "dead_letter_v",
        ),
        _one(
            "silver_has_rows", "count(*) > 0", "count(*) || ' canonical posts'", "silver_v"
        ),
        _one(
            "post_ids_are_unique", "count(*) = count(DISTINCT (tenant_id, platform, post_id))",
            "(count(*) - count(DISTINCT (tenant_id, platform, post_id))) || ' duplicate IDs'",
            "silver_v",
        ),
        _one(
            "required_fields_are_complete", "count(*) = 0", "count(*) || ' invalid rows'",
            "silver_v WHERE author_id IS NULL OR created_at IS NULL",
        ),
        _one(
            "data_is_recent",
            "trunc(epoch(TIMESTAMP '2024-01-31' - max(created_at)) / 3600) <= 2",
            "CAST(trunc(epoch(TIMESTAMP '2024-01-31' - max(created_at)) / 60) AS BIGINT) "
            "|| ' minutes old'",
            "silver_v",
        ),
        _one(
            "challenge_is_detected", "count(*) > 0", "count(*) || ' matching challenge rows'",
            "challenge_snapshot_v WHERE challenge_name = 'glowupchallenge'",
        ),
        _one(
            "brand_risk_is_detected", "sum(high_risk_mentions) > 0",
            "sum(high_risk_mentions)::BIGINT || ' high-risk mentions'", "brand_daily_v",
        ),
        _one(
            "trend_scores_are_bounded", "count(*) = 0", "count(*) || ' invalid scores'",
            "trend_hourly_v WHERE NOT trend_score BETWEEN 0 AND 100",
        ),
        _one(
            "model_review_queue_is_available", "count(*) > 0",
            "count(*) || ' review candidates'", "review_v",
        ),
        _one(
            "source_health_is_available",
            "count(*) > 0 AND count(*) FILTER (health_status IN "
            "('NO_DATA', 'STALE', 'DEGRADED')) = 0",
            "count(*) || ' sources; ' || count(*) FILTER (health_status <> 'HEALTHY') "
            "|| ' non-healthy'",
            "source_health_v",
        ),
        _one(
            "experience_signal_feed_is_available", "count(*) > 0",
            "count(*) || ' actionable signals'", "feed_v",
        ),
        _one(
            "opportunity_scores_are_bounded",
            "count(*) > 0 AND count(*) FILTER (p_size * 2 NOT BETWEEN 0 AND 100) = 0",
            "count(*) || ' opportunities; ' || count(*) FILTER (p_size * 2 NOT BETWEEN 0 AND 100) "
            "|| ' invalid scores'", "part",
        ),
        _one(
            "recommendations_have_evidence_and_parent", f"{_BAD_LINEAGE} = 0",
            f"count(*) || ' recommendations; ' || {_BAD_LINEAGE} || ' invalid records'", _LINEAGE,
        ),
        _one(
            "experiments_require_approved_recommendations",
            "count(*) FILTER (r.recommendation_id IS NULL) = 0",
            "count(*) || ' experiments; ' || count(*) FILTER (r.recommendation_id IS NULL) || ' orphaned'",
            "experiments_v e LEFT JOIN recommendations_v r USING (recommendation_id)",
        ),
    ]
)


@query("product_checks", _PRODUCT_CHECKS)
def product_checks(spark, folder):
    """Checks of stored tables: most from counts observed while the tables were written."""
    stored = _product_tables(spark, folder)
    tables = stored.tables(
        "control_source_registry", "bronze_social_events", "bronze_dead_letter_events",
        "silver_social_posts", "gold_challenge_snapshot", "gold_brand_daily", "gold_trend_hourly",
        "gold_model_review_queue", "gold_source_health", "gold_signal_feed", "gold_opportunities",
        "decision_recommendations", "decision_experiments",
    )
    return quality.product_checks(tables, t.AS_OF, stored.observed())


def _external_sql(source: str) -> str:
    """The six gates; two more sources are registered, one of them switched off."""
    own = f"WHERE tenant_id = 't0' AND source_id = '{source}'"
    registered = """(SELECT tenant_id, source_id, enabled FROM registry_v
      UNION ALL VALUES ('t0', '2-HIGH', true), ('t0', '3-MEDIUM', false))"""
    return "\nUNION ALL ".join(
        [
            _one(
                "source_is_registered", "count(*) FILTER (enabled) = 1",
                "count(*) FILTER (enabled) || ' enabled source registrations'", f"{registered} {own}",
            ),
            _one(
                "latest_collection_succeeded",
                "count(*) FILTER (status = 'SUCCESS' AND run_age_minutes <= 180) = 1",
                "'status=' || max(status) || ', age_minutes=' || max(run_age_minutes)",
                f"operations_v {own}",
            ),
            _one(
                "quota_headroom_is_positive", "max(search_calls_remaining) > 0",
                "'search_remaining=' || max(search_calls_remaining) || ', core_remaining=' "
                "|| max(core_units_remaining) || ', requests_remaining=-1'", f"operations_v {own}",
            ),
            _one(
                "source_has_delivered_events", "count(*) > 0", "count(*) || ' delivered events'",
                f"deliveries_v {own}",
            ),
            _one(
                "source_dead_letter_is_empty", "count(*) = 0", "count(*) || ' rejected events'",
                f"dead_letter_v {own}",
            ),
            _one(
                "decision_records_have_valid_lineage", f"{_BAD_LINEAGE} = 0",
                f"count(*) || ' recommendations; ' || {_BAD_LINEAGE} || ' invalid records'",
                f"{_LINEAGE} WHERE r.tenant_id = 't0'",
            ),
        ]
    )


def _external(spark, folder, source: str):
    more = t.registry(spark).filter("tenant_id = 't0' AND source_id = 'src-reddit'")
    both = F.explode(F.array(
        F.struct(F.lit("2-HIGH").alias("id"), F.lit(True).alias("on")),
        F.struct(F.lit("3-MEDIUM").alias("id"), F.lit(False).alias("on")),
    ))
    more = more.withColumn("x", both).withColumns(
        {"source_id": F.col("x.id"), "enabled": F.col("x.on")}
    ).select(*schemas.SOURCE_REGISTRY.names)
    deliveries, registry = t.deliveries(spark, folder), t.registry(spark)
    tables = {
        "control_source_registry": registry.unionByName(more),
        "gold_connector_operations": operations(spark, folder),
        "bronze_social_events": deliveries,
        "bronze_dead_letter_events": dead_letter(deliveries, t.contracts(spark), registry),
        "decision_recommendations": t.recommendations(spark, folder),
        "gold_opportunities": _part_opportunities(spark, folder),
    }
    return quality.external_checks(tables, t.TENANT, source)


@query("external_checks", _external_sql("1-URGENT"))
def external_checks(spark, folder):
    """Gates of a source that runs collections but is not registered."""
    return _external(spark, folder, "1-URGENT")


@query("external_checks_registered", _external_sql("2-HIGH"))
def external_checks_registered(spark, folder):
    """Gates of a registered, enabled source."""
    return _external(spark, folder, "2-HIGH")


@query("external_checks_disabled", _external_sql("3-MEDIUM"))
def external_checks_disabled(spark, folder):
    """Gates of a source that is registered but switched off."""
    return _external(spark, folder, "3-MEDIUM")


@query(
    "alerts",
    """SELECT alert_name, alert_value, threshold,
      CASE WHEN (alert_name = 'source_freshness' AND alert_value > threshold)
        OR (alert_name <> 'source_freshness' AND alert_value >= threshold)
        THEN 'TRIGGERED' ELSE 'OK' END AS alert_state
    FROM (
      SELECT 'emerging_trend' AS alert_name, max(trend_score)::DOUBLE AS alert_value,
        45.0::DOUBLE AS threshold FROM trend_snapshot_v WHERE tenant_id = 't0'
      UNION ALL SELECT 'brand_risk', coalesce(sum(high_risk_mentions), 0)::DOUBLE, 1
        FROM brand_daily_v WHERE tenant_id = 't0' AND metric_date =
          (SELECT max(metric_date) FROM brand_daily_v WHERE tenant_id = 't0')
      UNION ALL SELECT 'source_freshness', max(freshness_minutes)::DOUBLE, 90
        FROM source_health_v WHERE tenant_id = 't0' AND enabled)""",
)
def alerts(spark, folder):
    silver = t.silver(spark, folder)
    trends = metrics.trend_snapshot(metrics.trend_hourly(metrics.topic_hourly(silver)))
    values = quality.alert_values(
        trends, metrics.brand_daily(silver), health(spark, folder), t.TENANT
    )
    return quality.evaluate_alerts(values).drop("comparison")


@query(
    "owned_signals",
    """SELECT tenant_id, 'trend' AS signal, topic AS subject, round(trend_score, 6) AS value
      FROM trend_snapshot_v WHERE trend_score >= 20
    UNION ALL SELECT tenant_id, 'challenge', challenge_name, round(challenge_score, 6)
      FROM challenge_snapshot_v WHERE challenge_score >= 50
    UNION ALL SELECT tenant_id, 'brand', brand || ' ' || CAST(metric_date AS VARCHAR),
        round(negative_share, 6)
      FROM brand_daily_v WHERE negative_share >= 0.25 AND high_risk_mentions > 0""",
)
def owned_signals(spark, folder):
    """Signals in their ownership bands; trends under a lower band, which the data reach."""
    silver = t.silver(spark, folder)
    rows = quality.owned_signals(
        metrics.trend_snapshot(metrics.trend_hourly(metrics.topic_hourly(silver))),
        metrics.challenge_snapshot(metrics.challenge_hourly(silver)),
        metrics.brand_daily(silver),
        quality.OWNERSHIP_BANDS | {"trend": 20.0},
    )
    return rows.withColumn("value", F.round("value", 6))


@query(
    "emerging_trend_alert",
    f"""SELECT topic, trend_score, {six('velocity_z', 'acceleration_pct')}, hour_ts
    FROM trend_hourly_v WHERE tenant_id = 't0' AND trend_score >= 70""",
)
def emerging_trend_alert(spark, folder):
    """Over all topic hours, not only the latest, so that there is something to find."""
    trends = metrics.trend_hourly(metrics.topic_hourly(t.silver(spark, folder)))
    return t.plain(quality.emerging_trend_alert(trends, t.TENANT))


@query(
    "brand_risk_alert",
    """SELECT CAST(metric_date AS VARCHAR) AS metric_date, brand,
      round(negative_share, 6) AS negative_share, high_risk_mentions
    FROM brand_daily_v WHERE tenant_id = 't0' AND negative_share >= 0.25
      AND high_risk_mentions >= 10 AND metric_date =
        (SELECT max(metric_date) FROM brand_daily_v WHERE tenant_id = 't0')""",
)
def brand_risk_alert(spark, folder):
    brand = metrics.brand_daily(t.silver(spark, folder))
    return t.plain(quality.brand_risk_alert(brand, t.TENANT))


@query(
    "stale_feed_alert",
    """SELECT max(created_at) AS newest_post,
      CAST(trunc(epoch(TIMESTAMP '2024-01-31' - max(created_at)) / 60) AS BIGINT) AS minutes_old
    FROM silver_v WHERE tenant_id = 't0'
    HAVING trunc(epoch(TIMESTAMP '2024-01-31' - max(created_at)) / 60) > 30""",
)
def stale_feed_alert(spark, folder):
    return t.plain(quality.stale_feed_alert(t.silver(spark, folder), t.TENANT, t.AS_OF))


@query(
    "latest_brand_day",
    """SELECT tenant_id, CAST(metric_date AS VARCHAR) AS metric_date, brand, mentions
    FROM brand_daily_v b WHERE metric_date = (SELECT max(l.metric_date) FROM brand_daily_v l
      WHERE l.tenant_id = b.tenant_id)""",
)
def latest_day(spark, folder):
    rows = latest_brand_day(metrics.brand_daily(t.silver(spark, folder)))
    return t.plain(rows.select("tenant_id", "metric_date", "brand", "mentions"))
