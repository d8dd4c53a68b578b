"""Enrichment, hourly and daily facts, snapshots and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.operators import metrics, posts, signals
from tidemark.plans import read_packs
from tidemark.queries import tables as t
from tidemark.queries.oracles import six
from tidemark.queries.registry import query
from tidemark.queries.stored import Stored

_HOURLY = (
    "tenant_id, hour_ts, topic, post_count, creator_count, platform_count, geography_count, "
    "views, engagements, shares, "
    + six("avg_engagement_rate", "positive_share", "negative_share")
)


@query(
    "engagement",
    f"""SELECT post_id, engagements, {six('engagement_rate')}, topic, sentiment_label,
    risk_level, enrichment_model_version FROM silver_v""",
)
def engagement(spark, folder):
    return t.plain(
        t.silver(spark, folder).select(
            "post_id", "engagements", "engagement_rate", "topic", "sentiment_label",
            "risk_level", "enrichment_model_version",
        )
    )


@query(
    "canonical_posts",
    "SELECT tenant_id, platform, post_id, created_at, views FROM posts_v WHERE views >= 0",
)
def canonical_posts(spark, folder):
    rows = posts.canonical_posts(t.posts(spark, folder))
    return t.plain(rows.select("tenant_id", "platform", "post_id", "created_at", "views"))


@query(
    "dedup_posts",
    """SELECT tenant_id, platform, post_id, event_id, collected_at, views FROM observed_v
    QUALIFY row_number() OVER (PARTITION BY tenant_id, platform, post_id
      ORDER BY collected_at DESC, ingested_at DESC, event_id DESC) = 1""",
)
def dedup_posts(spark, folder):
    rows = posts.dedup_posts(t.observed_posts(spark, folder))
    return t.plain(
        rows.select("tenant_id", "platform", "post_id", "event_id", "collected_at", "views")
    )


@query(
    "silver_posts",
    f"""SELECT post_id, event_id, views, engagements, {six('engagement_rate')}, topic,
      sentiment_label, risk_level
    FROM (SELECT *, likes + comments + shares + saves AS engagements,
        CASE WHEN views > 0 THEN (likes + comments + shares + saves)::DOUBLE / views ELSE 0 END
          AS engagement_rate
      FROM observed_v WHERE views >= 0
      QUALIFY row_number() OVER (PARTITION BY tenant_id, platform, post_id
        ORDER BY collected_at DESC, ingested_at DESC, event_id DESC) = 1)
    JOIN (SELECT post_id, topic, sentiment_label, risk_level FROM silver_v) USING (post_id)""",
)
def silver_posts(spark, folder):
    rows = posts.silver_posts(t.observed_posts(spark, folder))
    return t.plain(
        rows.select(
            "post_id", "event_id", "views", "engagements", "engagement_rate", "topic",
            "sentiment_label", "risk_level",
        )
    )


@query("topic_hourly", f"SELECT {_HOURLY} FROM topic_hourly_v")
def topic_hourly(spark, folder):
    return t.plain(metrics.topic_hourly(t.silver(spark, folder)))


_PARTS = six(
    "baseline_posts", "baseline_post_stddev", "baseline_engagements",
    "baseline_engagement_stddev", "velocity_z", "engagement_velocity_z", "acceleration_pct",
    "novelty",
)


@query(
    "trend_components",
    f"""SELECT tenant_id, topic, hour_ts, previous_posts, first_seen_at, {_PARTS}
    FROM trend_parts_v""",
)
def trend_components(spark, folder):
    parts = metrics.trend_components(metrics.topic_hourly(t.silver(spark, folder)))
    return t.plain(
        parts.select(
            "tenant_id", "topic", "hour_ts", "previous_posts", "first_seen_at",
            "baseline_posts", "baseline_post_stddev", "baseline_engagements",
            "baseline_engagement_stddev", "velocity_z", "engagement_velocity_z",
            "acceleration_pct", "novelty",
        )
    )


def _trends(spark, folder):
    return metrics.trend_hourly(metrics.topic_hourly(t.silver(spark, folder)))


def _challenges(spark, folder):
    return metrics.challenge_hourly(t.silver(spark, folder))


def _brand(spark, folder):
    return metrics.brand_daily(t.silver(spark, folder))


@query("trend_hourly", f"SELECT {_HOURLY}, previous_posts, trend_score FROM trend_hourly_v")
def trend_hourly(spark, folder):
    columns = [
        "tenant_id", "hour_ts", "topic", "post_count", "creator_count", "platform_count",
        "geography_count", "views", "engagements", "shares", "avg_engagement_rate",
        "positive_share", "negative_share", "previous_posts", "trend_score",
    ]
    return t.plain(_trends(spark, folder).select(*columns))


@query(
    "trend_snapshot",
    """SELECT tenant_id, topic, hour_ts, post_count, creator_count, trend_score
    FROM trend_snapshot_v""",
)
def trend_snapshot(spark, folder):
    rows = metrics.trend_snapshot(_trends(spark, folder))
    return t.plain(
        rows.select(
            "tenant_id", "topic", "hour_ts", "post_count", "creator_count", "trend_score"
        )
    )


@query("challenge_participation", "SELECT * FROM participation_v")
def challenge_participation(spark, folder):
    return t.plain(metrics.challenge_participation(t.silver(spark, folder)))


_CHALLENGE = f"""SELECT tenant_id, challenge_name, hour_ts, participation_count,
  unique_creators, geography_count, platform_count, previous_participation,
  persistence_hours, {six('participant_growth_pct')}, challenge_score FROM """


@query("challenge_hourly", _CHALLENGE + "challenge_hourly_v")
def challenge_hourly(spark, folder):
    return t.plain(_challenges(spark, folder))


@query("challenge_snapshot", _CHALLENGE + "challenge_snapshot_v")
def challenge_snapshot(spark, folder):
    return t.plain(metrics.challenge_snapshot(_challenges(spark, folder)))


@query(
    "brand_daily",
    f"""SELECT tenant_id, CAST(metric_date AS VARCHAR) AS metric_date, brand, mentions,
    unique_authors, views, engagements,
    {six('avg_engagement_rate', 'positive_share', 'negative_share', 'net_sentiment')},
    high_risk_mentions FROM brand_daily_v""",
)
def brand_daily(spark, folder):
    return t.plain(_brand(spark, folder))


@query(
    "executive_kpis",
    f"""SELECT tenant_id, data_through, posts_24h, creators_24h, views_24h, engagements_24h,
    {six('avg_engagement_rate_24h', 'positive_share_24h', 'negative_share_24h')},
    high_risk_mentions_24h, active_topics_24h FROM kpis_v""",
)
def executive_kpis(spark, folder):
    return t.plain(metrics.executive_kpis(t.silver(spark, folder)))


@query(
    "platform_mix",
    """SELECT platform, count(*) AS posts, count(DISTINCT author_id) AS creators,
      sum(views)::BIGINT AS views, sum(engagements)::BIGINT AS engagements,
      round(avg(engagement_rate), 6) AS engagement_rate
    FROM silver_v WHERE tenant_id = 't0' AND created_at >=
      (SELECT max(created_at) FROM silver_v WHERE tenant_id = 't0') - INTERVAL 24 HOURS
    GROUP BY platform""",
)
def platform_mix(spark, folder):
    return t.plain(metrics.platform_mix(t.silver(spark, folder), t.TENANT))


@query(
    "top_brand_issues",
    """SELECT topic, geography, platform, count(*) AS mentions,
      count(DISTINCT author_id) AS creators, sum(views)::BIGINT AS views,
      arg_max(content_text, engagements * 1000000000 + n) AS representative_post
    FROM silver_v WHERE tenant_id = 't0' AND brand IS NOT NULL AND sentiment_label = 'negative'
    GROUP BY ALL""",
)
def top_brand_issues(spark, folder):
    return t.plain(metrics.top_brand_issues(t.silver(spark, folder), t.TENANT))


@query(
    "risk_by_topic",
    """SELECT topic, count(*) FILTER (risk_level = 'high') AS high_risk_mentions
    FROM silver_v WHERE tenant_id = 't0' GROUP BY topic""",
)
def risk_by_topic(spark, folder):
    return t.plain(metrics.risk_by_topic(t.silver(spark, folder), t.TENANT))


@query(
    "data_operations_summary",
    """SELECT max(created_at) AS newest_post, max(collected_at) AS newest_collection,
      count(*) AS canonical_rows, count(DISTINCT (platform, post_id)) AS unique_posts,
      count(*) FILTER (content_text IS NULL OR created_at IS NULL OR author_id IS NULL)
        AS invalid_rows,
      count(*) FILTER (engagement_rate < 0 OR engagement_rate > 1)
        AS suspicious_engagement_rates
    FROM silver_v WHERE tenant_id = 't0'""",
)
def data_operations_summary(spark, folder):
    return t.plain(metrics.data_operations_summary(t.silver(spark, folder), t.TENANT))


@query(
    "trending_topics",
    """SELECT tenant_id, source_id, platform, woeid, location, trend_name, tweet_count,
      observed_at
    FROM trends_v t WHERE observed_at = (SELECT max(l.observed_at) FROM trends_v l
      WHERE l.woeid = t.woeid)""",
)
def trending_topics(spark, folder):
    rows = metrics.trending_topics(t.trends(spark, folder), t.AS_OF)
    return t.plain(
        rows.select(
            "tenant_id", "source_id", "platform", "woeid", "location", "trend_name",
            "tweet_count", "observed_at",
        )
    )


_FEED = "tenant_id, signal_type, signal_key, signal_ts, score, severity, summary, evidence_count"


def feed(spark, folder):
    """Signal feed over all events."""
    silver = t.silver(spark, folder)
    trends = metrics.trend_snapshot(metrics.trend_hourly(metrics.topic_hourly(silver)))
    challenges = metrics.challenge_snapshot(metrics.challenge_hourly(silver))
    return signals.signal_feed(trends, challenges, metrics.brand_daily(silver))


@query("signal_feed", f"SELECT {_FEED}, source_table FROM feed_v")
def signal_feed(spark, folder):
    return t.plain(feed(spark, folder))


_OPPORTUNITY = """opportunity_id, tenant_id, opportunity_type, signal_type, signal_key,
  signal_ts, product_id, product_name, preferred_channel, target_audience, signal_score,
  evidence_count, product_fit, commercial_fit, opportunity_score, confidence_score, status,
  title, expires_at"""


def opportunity_table(spark, folder):
    return signals.opportunities(
        feed(spark, folder), t.signal_map(spark), t.products(spark, folder), t.AS_OF
    )


@query("opportunities", f"SELECT {_OPPORTUNITY} FROM opportunities_v")
def opportunities(spark, folder):
    names = [c.strip() for c in _OPPORTUNITY.replace("\n", " ").split(",")]
    return t.plain(opportunity_table(spark, folder).select(*names))


@query(
    "opportunity_score",
    """SELECT p_partkey, round(least(100.0::DOUBLE, 100 * (0.55 * least(1, p_size / 40.0::DOUBLE)
        + 0.15 * least(1, ln(1 + p_partkey::DOUBLE) / ln(101.0::DOUBLE))
        + 0.2 * (p_partkey % 10 / 10.0::DOUBLE) + 0.1 * (p_partkey % 4 / 4.0::DOUBLE))), 2)
      AS opportunity_score,
    round(100 * (0.45 * least(1, p_size / 40.0::DOUBLE)
        + 0.2 * least(1, ln(1 + p_partkey::DOUBLE) / ln(101.0::DOUBLE))
        + 0.2 * (p_partkey % 10 / 10.0::DOUBLE) + 0.15 * (p_partkey % 4 / 4.0::DOUBLE)), 2)
      AS confidence_score
    FROM part""",
)
def opportunity_score(spark, folder):
    key = F.col("p_partkey")
    inputs = (
        F.col("p_size") / 40.0 * 100.0,
        key,
        (key % 10) / 10.0,
        (key % 4) / 4.0,
    )
    return t.load(spark, folder, "part").select(
        "p_partkey",
        scoring.opportunity_score(*inputs).alias("opportunity_score"),
        scoring.confidence_score(*inputs).alias("confidence_score"),
    )


@query(
    "severity",
    """SELECT severity, count(*) AS parts FROM (
      SELECT CASE WHEN p_size * 2 >= 70 THEN 'critical' WHEN p_size * 2 >= 45 THEN 'high'
        ELSE 'info' END AS severity FROM part) GROUP BY severity""",
)
def severity(spark, folder):
    level = scoring.severity(F.col("p_size") * 2)
    return (
        t.load(spark, folder, "part")
        .groupBy(level.alias("severity"))
        .agg(F.count(F.lit(1)).alias("parts"))
    )


@query(
    "attest_scores",
    """SELECT opportunity_id, signal_type <> 'challenge' AS attested FROM opportunities_v""",
)
def attest_scores(spark, folder):
    """Receipts of the opportunities; those of challenge signals are tampered with."""
    receipts = opportunity_table(spark, folder).select(
        "opportunity_id", "signal_score", "evidence_count", "product_fit", "commercial_fit",
        F.when(F.col("signal_type") == "challenge", F.col("opportunity_score") + 1)
        .otherwise(F.col("opportunity_score"))
        .alias("priority_score"),
        "confidence_score",
    )
    return signals.attest_scores(receipts).select("opportunity_id", "attested")


@query(
    "review_queue",
    "SELECT * FROM review_v",
)
def review_queue(spark, folder):
    return t.plain(posts.review_queue(t.silver(spark, folder)))


def _accuracy(human: str, model: str) -> str:
    return (
        f"round(avg(CASE WHEN l.{human} = s.{model} THEN 1.0::DOUBLE ELSE 0 END), 6)"
    )


@query(
    "model_quality_daily",
    f"""SELECT tenant_id, CAST(CAST(l.reviewed_at AS DATE) AS VARCHAR) AS metric_date,
      enrichment_model_version, count(*) AS reviewed_posts,
      {_accuracy('reviewed_topic', 'topic')} AS topic_accuracy,
      {_accuracy('reviewed_sentiment', 'sentiment_label')} AS sentiment_accuracy,
      {_accuracy('reviewed_risk_level', 'risk_level')} AS risk_accuracy
    FROM silver_v s JOIN labels_v l USING (tenant_id, platform, post_id)
    GROUP BY tenant_id, CAST(l.reviewed_at AS DATE), enrichment_model_version""",
)
def model_quality_daily(spark, folder):
    return t.plain(
        posts.model_quality_daily(
            t.silver(spark, folder), t.human_labels(spark, folder), t.AS_OF
        )
    )


@query(
    "extract_hashtags",
    r"""SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS hashtags FROM (
      SELECT doc_id, list_filter(tags, lambda tag, i: list_position(tags, tag) = i)
        AS list_distinct_in_order
      FROM (SELECT doc_id, regexp_extract_all(
          replace(replace(text, chr(10), ' #'), '. ', '. #'), '(?:^|[^\w\p{L}])#([\w\p{L}-]+)', 1)
          AS tags FROM documents))""",
)
def extract_hashtags(spark, folder):
    """Every line and sentence of the documents starts with a hash sign, then is parsed."""
    marked = F.replace(
        F.replace(F.col("text"), F.lit("\n"), F.lit(" #")), F.lit(". "), F.lit(". #")
    )
    return t.load(spark, folder, "documents").select(
        "doc_id", F.concat_ws(",", text.extract_hashtags(marked)).alias("hashtags")
    )


@query(
    "dashboard_measures",
    """SELECT 'trend_score' AS measure, topic AS label, max(trend_score) AS value
      FROM trend_snapshot_v WHERE tenant_id = 't0' GROUP BY topic
    UNION ALL SELECT 'challenge_score', challenge_name, max(challenge_score)
      FROM challenge_snapshot_v WHERE tenant_id = 't0' GROUP BY challenge_name
    UNION ALL SELECT 'negative_share', CAST(metric_date AS VARCHAR),
        round(avg(negative_share), 6)
      FROM brand_daily_v WHERE tenant_id = 't0' GROUP BY metric_date
    UNION ALL SELECT 'delivered_events', platform, sum(delivered_events)::DOUBLE
      FROM source_health_v WHERE tenant_id = 't0' GROUP BY platform
    UNION ALL SELECT 'signal_score', signal_key, max(score)
      FROM feed_v WHERE tenant_id = 't0' GROUP BY signal_key""",
)
def dashboard_measures(spark, folder):
    """The charted measures over stored marts; the feed rests on three of them."""
    snapshots = ("gold_trend_snapshot", "gold_challenge_snapshot", "gold_brand_daily")
    stored = Stored(spark, folder, snapshots)
    tables = stored.tables(*snapshots, "gold_source_health", "gold_signal_feed")
    return t.plain(read_packs.dashboard_measures(tables, t.TENANT))
