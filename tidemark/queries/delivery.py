"""Envelopes, quarantine, acceptance, parsing, source health and connector runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scoring
from tidemark.operators import envelope, health as health_ops, posts
from tidemark.queries import tables as t
from tidemark.queries.oracles import RUNS_AS_OF, minutes
from tidemark.queries.registry import query
from tidemark.sources.files import inline_values


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def _short_iso(column: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {column}) = {column} "
        f"THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE {_iso(column)} END"
    )


@query(
    "idempotency_key",
    f"""SELECT post_id, sha256(concat_ws('|', lower(tenant_id), platform, post_id,
      'social.post.observed', {_iso('created_at')})) AS idempotency_key FROM posts_v""",
)
def idempotency_key(spark, folder):
    from tidemark.functions.identity import idempotency_key as key

    rows = t.posts(spark, folder)
    return rows.select(
        "post_id",
        key(
            F.upper(F.concat(F.lit(" "), "tenant_id")),
            F.col("platform"),
            F.col("post_id"),
            F.lit("Social.Post.Observed"),
            F.col("created_at"),
        ).alias("idempotency_key"),
    )


@query(
    "build_envelope",
    f"""SELECT sha256('delivery|' || k || '|' || {_iso('collected_at')}) AS event_id,
      '1.0' AS schema_version, tenant_id, source_id, k AS idempotency_key,
      created_at AS occurred_at, collected_at, payload FROM (
      SELECT *, source_payload AS payload, sha256(concat_ws('|', tenant_id, platform, post_id,
        'social.post.observed', {_iso('created_at')})) AS k FROM posts_v)""",
)
def build_envelope(spark, folder):
    rows = envelope.build_envelope(
        t.posts(spark, folder),
        tenant_id=F.col("tenant_id"),
        source_id=F.col("source_id"),
        platform=F.col("platform"),
        event_type=F.lit("social.post.observed"),
        source_object_id=F.col("post_id"),
        occurred_at=F.col("created_at"),
        collected_at=F.col("collected_at"),
        payload=F.col("source_payload"),
    )
    return t.plain(
        rows.select(
            "event_id", "schema_version", "tenant_id", "source_id", "idempotency_key",
            "occurred_at", "collected_at", "payload",
        )
    )


@query(
    "validate_envelope",
    """SELECT event_id, errors AS validation_errors, errors = '' AS is_valid FROM (
      SELECT event_id, concat_ws(',',
        CASE WHEN idempotency_key IS NULL THEN 'missing_idempotency_key' END,
        CASE WHEN tenant_id IS NULL THEN 'missing_tenant_id' END,
        CASE WHEN schema_version <> '1.0' THEN 'unsupported_schema_version' END,
        CASE WHEN payload IS NULL THEN 'missing_payload' END) AS errors FROM deliveries_v)""",
)
def validate_envelope(spark, folder):
    rows = envelope.validate_envelope(t.deliveries(spark, folder), strict=True)
    return rows.select("event_id", "validation_errors", "is_valid")


@query(
    "envelope_to_record",
    f"""SELECT event_id, {_short_iso('occurred_at')} AS occurred_at,
    {_short_iso('collected_at')} AS collected_at,
    '{{"a":[{{"c":1,"d":2}}],"z":{{"b":null,"y":' || replace(payload, ': ', ':') || '}}}}'
      AS payload FROM deliveries_v""",
)
def envelope_to_record(spark, folder):
    """Payloads nested below keys that are out of order on every level."""
    nested = F.concat(
        F.lit('{"z": {"y": '), F.col("payload"), F.lit(', "b": null}, "a": [{"d": 2, "c": 1}]}')
    )
    rows = envelope.envelope_to_record(
        t.deliveries(spark, folder).withColumn("payload", nested)
    )
    return rows.select("event_id", "occurred_at", "collected_at", "payload")


@query(
    "to_cloudevent",
    f"""SELECT '1.0' AS specversion, event_id AS id,
      'urn:audience-signals:' || tenant_id || ':' || platform || ':' || source_id AS source,
      event_type AS type, platform || '/' || source_object_id || '%20~%2A%2F' AS subject,
      {_short_iso('occurred_at')} AS time, 'application/json' AS datacontenttype,
      tenant_id AS tenantid, source_id AS sourceid, correlation_id AS correlationid,
      idempotency_key AS idempotencykey, {_short_iso('collected_at')} AS collectedat,
      schema_version AS schemaversion,
      '{{"schema_version":"1.0","payload":' || replace(payload, ': ', ':')
        || ',"attributes":{{"delivery_mode":"batch"}}}}' AS data
    FROM accepted_v""",
)
def to_cloudevent(spark, folder):
    accepted = envelope.accept_events(
        t.deliveries(spark, folder), t.contracts(spark), t.registry(spark)
    ).withColumn("source_object_id", F.concat("source_object_id", F.lit(" ~*/")))
    events = envelope.to_cloudevent(accepted)
    return events.select(
        *[c for c in events.columns if c not in ("data", "dataschema")],
        F.to_json("data").alias("data"),
    )


@query(
    "dead_letter",
    """SELECT event_id, tenant_id, source_id, event_type, collected_at, rejection_reasons
    FROM dead_letter_v""",
)
def dead_letter(spark, folder):
    rows = envelope.dead_letter(
        t.deliveries(spark, folder), t.contracts(spark), t.registry(spark)
    )
    return t.plain(
        rows.select(
            "event_id", "tenant_id", "source_id", "event_type", "collected_at",
            "rejection_reasons",
        )
    )


@query(
    "classify_deliveries",
    """SELECT d.event_id, d.source_id, concat_ws(',', nullif(x.rejection_reasons, ''),
      CASE WHEN d.n % 13 = 0 AND d.payload IS NOT NULL THEN 'unparseable_payload' END)
      AS rejection_reasons
    FROM deliveries_v d LEFT JOIN dead_letter_v x ON x.event_id = d.event_id""",
)
def classify_deliveries(spark, folder):
    """All deliveries with their reasons; every thirteenth payload is cut off."""
    number = F.col("source_object_id").cast("bigint")
    broken = F.when(number % 13 == 0, F.left("payload", F.length("payload") - 1))
    deliveries = t.deliveries(spark, folder).withColumn(
        "payload", broken.when(number % 13 != 0, F.col("payload"))
    )
    rows = envelope.classify_deliveries(
        deliveries, t.contracts(spark), t.registry(spark), reject_unparseable=True
    )
    return rows.select("event_id", "source_id", "rejection_reasons")


@query(
    "inline_values",
    """SELECT r.tenant_id, r.source_id, r.enabled, count(p.post_id) AS posts
    FROM registry_v r LEFT JOIN posts_v p
      ON p.tenant_id = r.tenant_id AND p.source_id = r.source_id
    GROUP BY ALL""",
)
def inline_registry(spark, folder):
    """Posts per source of the literal registry, reduced before they meet it."""
    posts_per_source = (
        t.posts(spark, folder).groupBy("tenant_id", "source_id").agg(F.count("post_id").alias("posts"))
    )
    return (
        t.registry(spark)
        .join(posts_per_source, ["tenant_id", "source_id"], "left")
        .fillna(0, ["posts"])
        .select("tenant_id", "source_id", "enabled", "posts")
    )


def _accepted(spark, folder, full_payload=False):
    return envelope.accept_events(
        t.deliveries(spark, folder, full_payload), t.contracts(spark), t.registry(spark)
    )


@query(
    "accept_events",
    """SELECT event_id, tenant_id, source_id, event_type, idempotency_key, collected_at
    FROM accepted_v""",
)
def accept_events(spark, folder):
    rows = _accepted(spark, folder)
    return t.plain(
        rows.select(
            "event_id", "tenant_id", "source_id", "event_type", "idempotency_key",
            "collected_at",
        )
    )


@query(
    "dedup_deliveries",
    "SELECT event_id, tenant_id, idempotency_key, collected_at FROM deduped_v",
)
def dedup_deliveries(spark, folder):
    rows = posts.dedup_deliveries(_accepted(spark, folder))
    return t.plain(rows.select("event_id", "tenant_id", "idempotency_key", "collected_at"))


@query(
    "parse_post_payload",
    """SELECT d.event_id, d.tenant_id, d.source_id, d.idempotency_key, p.post_id, p.platform,
      p.author_id, p.content_text, array_to_string(p.hashtags, ',') AS hashtags, p.audio_id,
      p.created_at, p.collected_at, p.views, p.likes, p.comments, p.shares, p.saves,
      p.geography, p.brand, d.ingested_at
    FROM deduped_v d JOIN posts_v p ON p.post_id = d.source_object_id""",
)
def parse_post_payload(spark, folder):
    deliveries = posts.dedup_deliveries(_accepted(spark, folder, full_payload=True))
    rows = envelope.parse_post_payload(deliveries)
    return t.plain(
        rows.select(
            "event_id", "tenant_id", "source_id", "idempotency_key", "post_id", "platform",
            "author_id", "content_text", "hashtags", "audio_id", "created_at", "collected_at",
            "views", "likes", "comments", "shares", "saves", "geography", "brand",
            "ingested_at",
        )
    )


@query(
    "parse_trend_payload",
    """SELECT tenant_id, trend_name, tweet_count, woeid, location, observed_at,
      CASE WHEN woeid = 3 THEN NULL ELSE CAST(tweet_count % 7 AS INTEGER) END AS trend_rank
    FROM trends_v WHERE woeid <> 4""",
)
def parse_trend_payload(spark, folder):
    """Trend rows as envelopes; place 4 lacks its id and place 3 a readable rank."""
    place = F.when(F.col("woeid") != 4, F.col("woeid"))
    rank = F.when(F.col("woeid") == 3, F.lit("n/a")).otherwise(
        (F.col("tweet_count") % 7).cast("string")
    )
    payload = F.to_json(
        F.struct(
            "platform", "trend_name", "tweet_count", place.alias("woeid"), "location",
            "observed_at", "source_payload",
        )
    )
    rows = envelope.build_envelope(
        t.trends(spark, folder),
        tenant_id=F.col("tenant_id"),
        source_id=F.col("source_id"),
        platform=F.col("platform"),
        event_type=F.lit("social.trend.observed"),
        source_object_id=F.concat_ws(":", F.lit("trend"), "woeid", "trend_name"),
        occurred_at=F.col("observed_at"),
        collected_at=F.col("collected_at"),
        payload=payload,
        attributes=F.create_map(F.lit("trend_rank"), rank),
    ).withColumn("ingested_at", F.col("collected_at"))
    parsed = envelope.parse_trend_payload(rows)
    return t.plain(
        parsed.select(
            "tenant_id", "trend_name", "tweet_count", "woeid", "location", "observed_at",
            "trend_rank",
        )
    )


@query("source_delivery", "SELECT * FROM delivery_v")
def source_delivery(spark, folder):
    return t.plain(health_ops.source_delivery(t.deliveries(spark, folder)))


@query("source_rejections", "SELECT * FROM rejected_v")
def source_rejections(spark, folder):
    rejected = envelope.dead_letter(
        t.deliveries(spark, folder), t.contracts(spark), t.registry(spark)
    )
    return health_ops.source_rejections(rejected)


def health(spark, folder):
    deliveries, registry = t.deliveries(spark, folder), t.registry(spark)
    rejected = envelope.dead_letter(deliveries, t.contracts(spark), registry)
    return health_ops.source_health(deliveries, rejected, registry, t.AS_OF)


@query("source_health", "SELECT * FROM source_health_v")
def source_health(spark, folder):
    return t.plain(health(spark, folder))


_RUN = """run_id, tenant_id, source_id, completed_at, status, videos_discovered,
  events_emitted, search_calls_remaining, failed_runs_last_24"""


@query("failed_runs", f"SELECT {_RUN} FROM failed_runs_v")
def failed_runs(spark, folder):
    names = [c.strip() for c in _RUN.replace("\n", " ").split(",")]
    return t.plain(health_ops.failed_runs(t.runs(spark, folder)).select(*names))


def operations(spark, folder):
    return health_ops.connector_operations(t.runs(spark, folder), t.RUNS_AS_OF)


@query(
    "connector_operations",
    f"""SELECT {_RUN}, videos_discovered AS source_objects_discovered, core_units_remaining,
    run_age_minutes, operational_status FROM operations_v""",
)
def connector_operations(spark, folder):
    names = [c.strip() for c in _RUN.replace("\n", " ").split(",")]
    return t.plain(
        operations(spark, folder).select(
            *names, "source_objects_discovered", "core_units_remaining", "run_age_minutes",
            "operational_status",
        )
    )


@query(
    "public_status",
    f"""SELECT run_id, source_id, status, completed_at, active_rules, videos_discovered,
      events_emitted, search_calls_remaining, search_calls_remaining * 10
        AS core_units_remaining,
      {minutes('completed_at', RUNS_AS_OF)} AS run_age_minutes,
      CASE WHEN status = 'FAILED' THEN 'DEGRADED'
        WHEN search_calls_remaining <= 5 OR search_calls_remaining * 10 <= 500
          THEN 'QUOTA_GUARD'
        WHEN {minutes('completed_at', RUNS_AS_OF)} > 180 THEN 'STALE'
        ELSE 'HEALTHY' END AS operational_status
    FROM runs_v QUALIFY row_number() OVER (PARTITION BY tenant_id, source_id
      ORDER BY completed_at DESC, run_id DESC) = 1""",
)
def public_status(spark, folder):
    rows = health_ops.public_status(t.runs(spark, folder), t.RUNS_AS_OF)
    return t.plain(
        rows.select(
            "run_id", "source_id", "status", "completed_at", "active_rules",
            "videos_discovered", "events_emitted", "search_calls_remaining",
            "core_units_remaining", "run_age_minutes", "operational_status",
        )
    )


@query(
    "quota_headroom",
    """SELECT tenant_id, source_id, bucket, CAST(day AS VARCHAR) AS quota_day, used,
      CASE bucket WHEN 'search' THEN 95 ELSE 9500 END::BIGINT AS usable,
      greatest(0, CASE bucket WHEN 'search' THEN 95 ELSE 9500 END - used)::BIGINT AS remaining
    FROM (SELECT 't' || (o_custkey % 3) AS tenant_id, o_orderpriority AS source_id,
        CASE o_orderkey % 2 WHEN 0 THEN 'search' ELSE 'core' END AS bucket,
        CAST(o_orderdate AS DATE) AS day, sum(o_orderkey % 90)::BIGINT AS used
      FROM orders GROUP BY ALL)""",
)
def quota_headroom(spark, folder):
    """Usage per order. The pair uses a UTC quota day; the default zone is tested apart."""
    key = F.col("o_orderkey")
    usage = t.load(spark, folder, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"),
        F.col("o_orderpriority").alias("source_id"),
        F.when(key % 2 == 0, F.lit("search")).otherwise(F.lit("core")).alias("bucket"),
        F.col("o_orderdate").alias("used_at"),
        (key % 90).alias("units"),
    )
    return t.plain(health_ops.quota_headroom(usage, time_zone="UTC"))


@query(
    "batch_statistics",
    """SELECT tenant_id, source_id, run_id, count(DISTINCT post_id) AS objects_discovered,
      count(DISTINCT post_id) AS events_emitted,
      CASE WHEN source_id = 'src-youtube' THEN 2 ELSE 0 END::BIGINT AS active_rules
    FROM (SELECT *, strftime(collected_at, '%Y-%m-%d') AS run_id FROM observed_v)
    GROUP BY ALL""",
)
def batch_statistics(spark, folder):
    """Observed posts as emitted events of one run per day; a source with two rules."""
    emitted = t.observed_posts(spark, folder).select(
        "tenant_id",
        "source_id",
        F.date_format("collected_at", "yyyy-MM-dd").alias("run_id"),
        F.col("post_id").alias("source_object_id"),
        F.col("post_id").alias("idempotency_key"),
    )
    rules = inline_values(
        spark,
        [
            (tenant, "src-youtube", rule, on)
            for tenant in ("t0", "t1", "t2")
            for rule, on in (("a", True), ("b", True), ("c", False))
        ],
        T.StructType.fromDDL(
            "tenant_id STRING, source_id STRING, rule_id STRING, enabled BOOLEAN"
        ),
    )
    return health_ops.batch_statistics(emitted, rules)


@query(
    "nonneg_int",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN greatest(0, CAST(o_custkey - 500
      AS BIGINT)) ELSE 0 END AS count_value FROM orders""",
)
def nonneg_int(spark, folder):
    """Customer keys as provider text: a third are numbers, some of them negative."""
    key = F.col("o_custkey")
    raw = F.when(key % 3 == 0, (key - 500).cast("string")).when(key % 3 == 1, F.lit("n/a"))
    return t.load(spark, folder, "orders").select(
        "o_orderkey", scoring.nonneg_int(raw).alias("count_value")
    )
