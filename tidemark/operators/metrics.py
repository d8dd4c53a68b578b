"""Hourly, daily and trailing-24-hour facts over canonical posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators.incremental import with_carried
from tidemark.operators.rows import latest_per_group

BASELINE_ROWS = 24
TRAILING_WINDOW = "INTERVAL 24 HOURS"


def _share(label: str) -> Column:
    return F.avg(F.when(F.col("sentiment_label") == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def _high_risk() -> Column:
    return F.count_if(F.col("risk_level") == "high")


def _net_sentiment() -> Column:
    polarity = (
        F.when(F.col("sentiment_label") == "positive", F.lit(1.0))
        .when(F.col("sentiment_label") == "negative", F.lit(-1.0))
        .otherwise(F.lit(0.0))
    )
    return F.avg(polarity)


def topic_hourly(posts: DataFrame) -> DataFrame:
    """Post, creator, reach and sentiment facts per tenant, hour and topic.

    Distinct counts first shuffle on (group, counted value), so a hot topic hour is
    spread over all reducers before its small final merge.
    """
    return posts.groupBy(
        "tenant_id", F.date_trunc("hour", "created_at").alias("hour_ts"), "topic"
    ).agg(
        F.count(F.lit(1)).alias("post_count"),
        F.count_distinct("author_id").alias("creator_count"),
        F.count_distinct("platform").alias("platform_count"),
        F.count_distinct("geography").alias("geography_count"),
        F.sum("views").alias("views"),
        F.sum("engagements").alias("engagements"),
        F.sum("shares").alias("shares"),
        F.avg("engagement_rate").alias("avg_engagement_rate"),
        _share("positive").alias("positive_share"),
        _share("negative").alias("negative_share"),
    )


#: What trend windows need of a topic's past hours, see ``incremental.window_state``.
TREND_MEASURES = ("post_count", "engagements")


def trend_components(hourly: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Baseline, previous value and first sighting of each topic hour, and the four
    component signals derived from them.

    The baseline is the 24 preceding *rows* (hours without posts have no row). All
    windows share one partitioning and order: one shuffle and one sort of hourly rows.
    With ``state`` the hours follow those that it was made from, and no others are read.
    """
    by_topic = Window.partitionBy("tenant_id", "topic").orderBy("hour_ts")
    baseline = by_topic.rowsBetween(-BASELINE_ROWS, -1)
    history = by_topic.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    framed = with_carried(hourly, state, "topic").withColumns(
        {
            "baseline_posts": F.avg("post_count").over(baseline),
            "baseline_post_stddev": F.stddev_samp("post_count").over(baseline),
            "baseline_engagements": F.avg("engagements").over(baseline),
            "baseline_engagement_stddev": F.stddev_samp("engagements").over(baseline),
            "previous_posts": F.lag("post_count").over(by_topic),
            "first_seen_at": F.min("_first").over(history),
        }
    )
    framed = framed.filter(~F.col("_carried")).drop("_carried", "_first")
    col = F.col
    return framed.withColumns(
        {
            "velocity_z": scoring.ratio_or_zero(
                col("post_count") - col("baseline_posts"), col("baseline_post_stddev")
            ),
            "engagement_velocity_z": scoring.ratio_or_zero(
                col("engagements") - col("baseline_engagements"),
                col("baseline_engagement_stddev"),
            ),
            "acceleration_pct": scoring.ratio_or_zero(
                col("post_count") - col("previous_posts"), col("previous_posts")
            ),
            "novelty": scoring.novelty(
                F.timestamp_diff("HOUR", col("first_seen_at"), col("hour_ts"))
            ),
        }
    )


def trend_hourly(
    hourly: DataFrame,
    manipulation_penalty: Column | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Explainable trend score of every topic hour."""
    return trend_components(hourly, state).withColumn(
        "trend_score",
        scoring.trend_score(
            F.col("velocity_z"),
            F.col("engagement_velocity_z"),
            F.col("acceleration_pct"),
            F.col("creator_count"),
            F.col("platform_count"),
            F.col("novelty"),
            F.col("positive_share"),
            manipulation_penalty,
        ),
    )


def latest_snapshot(hourly: DataFrame, entity: str) -> DataFrame:
    """Latest hour of every (tenant, entity)."""
    return latest_per_group(hourly, ["tenant_id", entity], [F.desc("hour_ts")])


def trend_snapshot(trends: DataFrame) -> DataFrame:
    return latest_snapshot(trends, "topic")


def challenge_participation(posts: DataFrame) -> DataFrame:
    """Hourly participation per challenge hashtag.

    A hashtag counts when it names a challenge or its post carries an audio track. Posts
    without hashtags do not take part.
    """
    tagged = posts.select(
        "tenant_id",
        F.date_trunc("hour", "created_at").alias("hour_ts"),
        "author_id",
        "geography",
        "platform",
        "audio_id",
        F.explode("hashtags").alias("hashtag"),
    )
    return (
        tagged.withColumn("challenge_name", F.lower("hashtag"))
        .filter(F.col("challenge_name").contains("challenge") | F.col("audio_id").isNotNull())
        .groupBy("tenant_id", "hour_ts", "challenge_name")
        .agg(
            F.count(F.lit(1)).alias("participation_count"),
            F.count_distinct("author_id").alias("unique_creators"),
            F.count_distinct("geography").alias("geography_count"),
            F.count_distinct("platform").alias("platform_count"),
        )
    )


#: What challenge windows need of a challenge's past hours: the last one.
CHALLENGE_MEASURES = ("participation_count",)
CHALLENGE_ROWS = 1


def challenge_growth(participation: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Growth against the previous row and hours since the first sighting.

    With ``state`` the hours follow those that it was made from.
    """
    by_name = Window.partitionBy("tenant_id", "challenge_name").orderBy("hour_ts")
    history = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("_first").over(history)
    grown = with_carried(participation, state, "challenge_name").withColumns(
        {
            "previous_participation": F.lag("participation_count").over(by_name),
            "persistence_hours": F.timestamp_diff("HOUR", first, F.col("hour_ts")) + 1,
        }
    )
    return grown.filter(~F.col("_carried")).drop("_carried", "_first").withColumn(
        "participant_growth_pct",
        scoring.ratio_or_zero(
            F.col("participation_count") - F.col("previous_participation"),
            F.col("previous_participation"),
        ),
    )


def challenge_hourly(posts: DataFrame) -> DataFrame:
    """Participation, growth, spread and score of every challenge hour."""
    return challenge_scores(challenge_participation(posts))


def challenge_scores(participation: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Growth and score of hourly participation, after the hours of ``state`` if given."""
    return challenge_growth(participation, state).withColumn(
        "challenge_score",
        scoring.challenge_score(
            F.col("participant_growth_pct"),
            F.col("unique_creators"),
            F.col("geography_count"),
            F.col("platform_count"),
            F.col("persistence_hours"),
        ),
    )


def challenge_snapshot(challenges: DataFrame) -> DataFrame:
    return latest_snapshot(challenges, "challenge_name")


def brand_daily(posts: DataFrame) -> DataFrame:
    """Mentions, reach, sentiment and risk per tenant, day and brand."""
    return (
        posts.filter(F.col("brand").isNotNull())
        .groupBy("tenant_id", F.to_date("created_at").alias("metric_date"), "brand")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.count_distinct("author_id").alias("unique_authors"),
            F.sum("views").alias("views"),
            F.sum("engagements").alias("engagements"),
            F.avg("engagement_rate").alias("avg_engagement_rate"),
            _share("positive").alias("positive_share"),
            _share("negative").alias("negative_share"),
            _net_sentiment().alias("net_sentiment"),
            _high_risk().alias("high_risk_mentions"),
        )
    )


def executive_kpis(posts: DataFrame) -> DataFrame:
    """Ten measures per tenant over the 24 hours up to the tenant's own newest post.

    The per-tenant cutoffs are one row per tenant, which Spark broadcasts while they measure
    small; the raw posts are then filtered before any shuffle. The earliest cutoff is one
    value that reaches the scan, which then skips the older row groups.
    """
    cutoffs = posts.groupBy("tenant_id").agg(
        (F.max("created_at") - F.expr(TRAILING_WINDOW)).alias("start_at")
    )
    earliest = cutoffs.agg(F.min("start_at")).scalar()
    recent = (
        posts.filter(F.col("created_at") >= earliest)
        .join(cutoffs, "tenant_id")
        .filter(F.col("created_at") >= F.col("start_at"))
    )
    return recent.groupBy("tenant_id").agg(
        F.max("created_at").alias("data_through"),
        F.count(F.lit(1)).alias("posts_24h"),
        F.count_distinct("author_id").alias("creators_24h"),
        F.sum("views").alias("views_24h"),
        F.sum("engagements").alias("engagements_24h"),
        F.avg("engagement_rate").alias("avg_engagement_rate_24h"),
        _share("positive").alias("positive_share_24h"),
        _share("negative").alias("negative_share_24h"),
        _high_risk().alias("high_risk_mentions_24h"),
        F.count_distinct("topic").alias("active_topics_24h"),
    )


KPI_DIMENSIONS = {"creator": "author_id", "topic": "topic"}
KPI_COLUMNS = (
    "author_id", "topic", "views", "engagements", "engagement_rate", "sentiment_label", "risk_level",
)
KPI_COUNTS = {"creator": "creators_24h", "topic": "active_topics_24h"}
#: Sums of doubles over the same numbers in another order may differ in their last bits.
_SHARE = {"positive": "positives", "negative": "negatives"}


def kpi_hours(posts: DataFrame, hour: Column | None = None) -> DataFrame:
    """Additive measures per tenant and hour, from which those of any span of hours follow."""
    hour = F.date_trunc("hour", "created_at") if hour is None else hour

    def labelled(label: str) -> Column:
        return F.count_if(F.col("sentiment_label") == label)

    return posts.groupBy("tenant_id", hour.alias("hour_ts")).agg(
        F.max("created_at").alias("newest_at"),
        F.count(F.lit(1)).alias("posts"),
        F.sum("views").alias("views"),
        F.sum("engagements").alias("engagements"),
        F.sum("engagement_rate").alias("rate_sum"),
        F.count("engagement_rate").alias("rates"),
        *[labelled(label).alias(name) for label, name in _SHARE.items()],
        _high_risk().alias("high_risk"),
    )


def kpi_windows(hours: DataFrame) -> DataFrame:
    """(tenant, start, edge): where each tenant's trailing 24 hours begin, and the hour of that."""
    newest = hours.groupBy("tenant_id").agg(F.max("newest_at").alias("newest_at"))
    start = (F.col("newest_at") - F.expr(TRAILING_WINDOW)).alias("start_at")
    return newest.select("tenant_id", start).withColumn("edge_ts", F.date_trunc("hour", "start_at"))


def kpis_from_hours(hours: DataFrame, counts: DataFrame) -> DataFrame:
    """Trailing measures out of the hours of the window and its distinct counts.

    ``hours`` holds the whole hours of every tenant's window and its cut first hour.
    """
    sums = hours.groupBy("tenant_id").agg(
        F.max("newest_at").alias("data_through"),
        F.sum("posts").alias("posts_24h"),
        F.sum("views").alias("views_24h"),
        F.sum("engagements").alias("engagements_24h"),
        (F.sum("rate_sum") / F.sum("rates")).alias("avg_engagement_rate_24h"),
        *[(F.sum(n) / F.sum("posts")).alias(f"{s}_share_24h") for s, n in _SHARE.items()],
        F.sum("high_risk").alias("high_risk_mentions_24h"),
    )
    return sums.join(counts, "tenant_id", "left").fillna(0, list(KPI_COUNTS.values())).select(
        "tenant_id", "data_through", "posts_24h", "creators_24h", "views_24h", "engagements_24h",
        "avg_engagement_rate_24h", "positive_share_24h", "negative_share_24h",
        "high_risk_mentions_24h", "active_topics_24h",
    )


def platform_mix(posts: DataFrame, tenant_id: str) -> DataFrame:
    """Posts, creators and reach per platform over a tenant's last 24 hours.

    The cutoff is an uncorrelated scalar subquery: one value, no join.
    """
    own = posts.filter(F.col("tenant_id") == tenant_id)
    start_at = own.agg(F.max("created_at") - F.expr(TRAILING_WINDOW)).scalar()
    return (
        own.filter(F.col("created_at") >= start_at)
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.count_distinct("author_id").alias("creators"),
            F.sum("views").alias("views"),
            F.sum("engagements").alias("engagements"),
            F.avg("engagement_rate").alias("engagement_rate"),
        )
        .orderBy(F.desc("views"), "platform")
    )


def top_brand_issues(posts: DataFrame, tenant_id: str) -> DataFrame:
    """Negative brand mentions by topic, place and platform with their strongest post.

    Ties in engagement go to the greatest post id, so that the representative text is
    the same on every run.
    """
    return (
        posts.filter(
            (F.col("tenant_id") == tenant_id)
            & F.col("brand").isNotNull()
            & (F.col("sentiment_label") == "negative")
        )
        .groupBy("topic", "geography", "platform")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.count_distinct("author_id").alias("creators"),
            F.sum("views").alias("views"),
            F.max_by("content_text", F.struct("engagements", "post_id")).alias(
                "representative_post"
            ),
        )
        .orderBy(F.desc("mentions"), "topic", "geography", "platform")
    )


def risk_by_topic(posts: DataFrame, tenant_id: str) -> DataFrame:
    return (
        posts.filter(F.col("tenant_id") == tenant_id)
        .groupBy("topic")
        .agg(_high_risk().alias("high_risk_mentions"))
    )


def data_operations_summary(posts: DataFrame, tenant_id: str) -> DataFrame:
    """Freshness, uniqueness and validity of a tenant's canonical posts, in one row."""
    identity = F.concat_ws(":", "tenant_id", "platform", "post_id")
    rate = F.col("engagement_rate")
    incomplete = (
        F.col("content_text").isNull()
        | F.col("created_at").isNull()
        | F.col("author_id").isNull()
    )
    return posts.filter(F.col("tenant_id") == tenant_id).agg(
        F.max("created_at").alias("newest_post"),
        F.max("collected_at").alias("newest_collection"),
        F.count(F.lit(1)).alias("canonical_rows"),
        F.count_distinct(identity).alias("unique_posts"),
        F.count_if(incomplete).alias("invalid_rows"),
        F.count_if((rate < 0) | (rate > 1)).alias("suspicious_engagement_rates"),
    )


def trending_topics(trends: DataFrame, refreshed_at=None) -> DataFrame:
    """Trend rows of the newest observation per tenant, source, platform and place.

    The newest observation is a map-side combined maximum that joins back to the rows;
    rows of one hot place are never sorted together in a single window partition.
    """
    place = ["tenant_id", "source_id", "platform", "woeid"]
    newest = trends.groupBy(*place).agg(F.max("observed_at").alias("observed_at"))
    newest = newest.toDF(*[f"_{name}" for name in newest.columns])
    stamp = F.current_timestamp() if refreshed_at is None else F.lit(refreshed_at)
    same = F.col("observed_at") == F.col("_observed_at")
    for name in place:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return trends.join(newest, same, "left_semi").select(
        *place,
        "location",
        "trend_name",
        "tweet_count",
        "trend_rank",
        "observed_at",
        "collected_at",
        "source_payload",
        stamp.cast("timestamp").alias("refreshed_at"),
    )
