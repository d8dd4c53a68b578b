"""Provider pages to canonical payloads, cursors and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.queries import tables as t
from tidemark.queries.registry import query
from tidemark.sources import cursors, providers

_POST = [
    "tenant_id", "post_id", "author_id", "content_text", "hashtags", "created_at", "views",
    "likes", "comments", "shares", "saves", "language",
]
_HEAD = "tenant_id, post_id"
_COUNTS = "created_at, views, likes, comments"


@query(
    "explode_provider_pages",
    """SELECT tenant_id, post_id AS object_id, 'rule-' || (n % 3) AS rule_id,
      n // 100 + 7 * later AS page_no, TIMESTAMP '2024-01-31' + to_days(later) AS collected_at
    FROM posts_v CROSS JOIN (VALUES (0), (1)) AS b(later)""",
)
def explode_provider_pages(spark, folder):
    """Every page is landed twice in one batch, and the next day in a batch of its own.

    The first page of a batch wins inside of it; both batches are observations.
    """
    pages = t.x_pages(spark, folder)
    again = pages.withColumn("page_no", F.col("page_no") + 1_000_000)
    later = pages.withColumns(
        {
            "page_no": F.col("page_no") + 7,
            "collected_at": F.col("collected_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    rows = providers.explode_provider_pages(
        pages.unionByName(again).unionByName(later), "data", providers.X_POST, "id"
    )
    return t.plain(rows.select("tenant_id", "object_id", "rule_id", "page_no", "collected_at"))


@query(
    "map_x_posts",
    f"""SELECT {_HEAD}, author_id, content_text || ' #Kiln #Letters' AS content_text,
      CASE WHEN audio_id IS NOT NULL THEN 'GlowUpChallenge,BalconyWeek' ELSE 'Kiln,Letters' END
        AS hashtags,
      {_COUNTS}, shares + 2 AS shares, saves, 'en' AS language FROM posts_v""",
)
def map_x_posts(spark, folder):
    return t.plain(providers.map_x_posts(t.x_pages(spark, folder)).select(*_POST))


@query(
    "map_x_trends",
    """SELECT woeid, trend_name, tweet_count, trend_rank, observed_at,
      'trend:' || woeid || ':' || substring(sha256(lower(trend_name)), 1, 20)
        AS source_object_id
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY woeid, observed_at
      ORDER BY tweet_count DESC, lower(trend_name)) AS INTEGER) AS trend_rank FROM trends_v)
    WHERE trend_rank <= 3""",
)
def map_x_trends(spark, folder):
    rows = providers.map_x_trends(t.x_trend_pages(spark, folder), top_n=3)
    return t.plain(
        rows.select(
            "woeid", "trend_name", "tweet_count", "trend_rank", "observed_at",
            "source_object_id",
        )
    )


@query(
    "rank_trends",
    """SELECT observed_at, woeid, trend_name, tweet_count, CAST(row_number() OVER (
      PARTITION BY observed_at, woeid ORDER BY tweet_count DESC, lower(trend_name)) AS INTEGER)
      AS trend_rank FROM trends_v QUALIFY trend_rank <= 2""",
)
def rank_trends(spark, folder):
    observed = t.trends(spark, folder).select(
        "observed_at", "woeid", "trend_name", "tweet_count"
    )
    return t.plain(providers.rank_trends(observed, ["observed_at", "woeid"], 2))


_TITLE = "content_text || ' #' || hashtags[1]"


@query(
    "map_youtube_videos",
    f"""SELECT {_HEAD}, 'channel-' || author_id AS author_id,
      {_TITLE} || CASE WHEN brand IS NOT NULL THEN chr(10) || 'About #Acme' ELSE '' END
        AS content_text,
      hashtags[1] || CASE WHEN brand IS NOT NULL THEN ',Acme' ELSE '' END AS hashtags,
      created_at, CASE WHEN known THEN views ELSE 0 END AS views,
      CASE WHEN known THEN likes ELSE 0 END AS likes,
      CASE WHEN known THEN comments ELSE 0 END AS comments,
      0::BIGINT AS shares, 0::BIGINT AS saves, 'en' AS language
    FROM (SELECT *, geography NOT LIKE 'PT%' AS known FROM posts_v)""",
)
def map_youtube_videos(spark, folder):
    rows = providers.map_youtube_videos(
        t.youtube_search_pages(spark, folder), t.youtube_statistics_pages(spark, folder)
    )
    return t.plain(rows.select(*_POST))


@query(
    "attach_video_stats",
    """SELECT tenant_id, post_id AS object_id,
      CASE WHEN geography NOT LIKE 'PT%' THEN CAST(views AS VARCHAR) END AS view_count
    FROM posts_v""",
)
def attach_video_stats(spark, folder):
    videos = providers.explode_provider_pages(
        t.youtube_search_pages(spark, folder), "items", providers.YOUTUBE_VIDEO, "id.videoId"
    )
    rows = providers.attach_video_stats(videos, t.youtube_statistics_pages(spark, folder))
    return rows.select(
        "tenant_id", "object_id", F.col("statistics.viewCount").alias("view_count")
    )


@query(
    "map_instagram_media",
    f"""SELECT {_HEAD}, 'acct-' || tenant_id AS author_id, {_TITLE} AS content_text,
      hashtags[1] AS hashtags, date_trunc('second', created_at) AS created_at, views, likes,
      comments, 0::BIGINT AS shares, 0::BIGINT AS saves, 'und' AS language,
      'u-' || tenant_id AS author_username, 'https://example.org/reel/' || post_id AS permalink,
      'REELS' AS media_type
    FROM posts_v""",
)
def map_instagram_media(spark, folder):
    accounts = providers.linked_accounts(t.instagram_account_pages(spark))
    rows = providers.map_instagram_media(t.instagram_pages(spark, folder), accounts)
    return t.plain(rows.select(*_POST, "author_username", "permalink", "media_type"))


@query(
    "unlinked_media",
    """SELECT tenant_id, post_id AS object_id, 'missing_linked_account' AS reason FROM posts_v
    WHERE tenant_id = 't1'""",
)
def unlinked_media(spark, folder):
    """The media of a tenant whose page has lost its account."""
    pages = t.instagram_account_pages(spark).filter("tenant_id <> 't1'")
    rows = providers.unlinked_media(t.instagram_pages(spark, folder), providers.linked_accounts(pages))
    return rows.select("tenant_id", "object_id", "reason")


_COMMENT = """tenant_id, comment_id AS post_id, role AS author_id, text AS content_text,
  TIMESTAMP '2024-01-10' AS created_at, 0::BIGINT AS views, likes"""


@query(
    "map_youtube_comments",
    f"""SELECT {_COMMENT}, (SELECT count(*) FROM turns_v r WHERE r.conv_id = c.conv_id
        AND r.turn > 0) AS comments,
      'top_level' AS comment_type, 'video-' || conv_id AS parent_video_id
    FROM turns_v c WHERE turn = 0""",
)
def map_youtube_comments(spark, folder):
    return _comments(providers.map_youtube_comments(t.thread_pages(spark, folder)))


@query(
    "map_youtube_replies",
    f"""SELECT {_COMMENT}, 0::BIGINT AS comments, 'reply' AS comment_type,
      'video-' || conv_id AS parent_video_id
    FROM turns_v WHERE turn > 0""",
)
def map_youtube_replies(spark, folder):
    return _comments(providers.map_youtube_replies(t.reply_pages(spark, folder)))


def _comments(rows):
    return t.plain(
        rows.select(
            "tenant_id", "post_id", "author_id", "content_text", "created_at", "views", "likes",
            "comments",
            F.col("attributes")["comment_type"].alias("comment_type"),
            F.col("attributes")["parent_video_id"].alias("parent_video_id"),
        )
    )


@query(
    "post_envelopes",
    """SELECT tenant_id, post_id, likes, shares + 2 AS shares, created_at, 'x-main' AS source_id,
      'rule-' || (n % 3) AS rule_id
    FROM posts_v""",
)
def post_envelopes(spark, folder):
    """X pages to envelopes and back through the post parser: nothing is lost."""
    from tidemark.operators.envelope import parse_post_payload

    landed = providers.post_envelopes(providers.map_x_posts(t.x_pages(spark, folder)))
    posts = parse_post_payload(landed.withColumn("ingested_at", F.col("collected_at")))
    return t.plain(
        posts.select(
            "tenant_id", "post_id", "likes", "shares", "created_at", "source_id",
            F.col("event_attributes")["rule_id"].alias("rule_id"),
        )
    )


@query(
    "trend_envelopes",
    """SELECT trend_name, woeid, tweet_count, observed_at, CAST(row_number() OVER (
      PARTITION BY woeid, observed_at ORDER BY tweet_count DESC, lower(trend_name)) AS INTEGER)
      AS trend_rank FROM trends_v""",
)
def trend_envelopes(spark, folder):
    """Trend pages to envelopes and back through the trend parser."""
    from tidemark.operators.envelope import parse_trend_payload

    landed = providers.trend_envelopes(providers.map_x_trends(t.x_trend_pages(spark, folder)))
    trends = parse_trend_payload(landed.withColumn("ingested_at", F.col("collected_at")))
    return t.plain(
        trends.select("trend_name", "woeid", "tweet_count", "observed_at", "trend_rank")
    )


@query(
    "consolidate_events",
    """SELECT tenant_id, post_id, arg_max(rule_id, rule_id) AS rule_id FROM (
      SELECT tenant_id, post_id, 'rule-' || (n % 3) AS rule_id FROM posts_v
      UNION ALL SELECT tenant_id, post_id, 'rule-1' FROM posts_v WHERE brand IS NOT NULL)
    GROUP BY ALL""",
)
def consolidate_events(spark, folder):
    """Branded posts are found by a second rule too; the last rule wins."""
    mapped = providers.map_x_posts(t.x_pages(spark, folder))
    branded = mapped.filter(F.col("content_text").startswith("Acme")).withColumns(
        {"rule_id": F.lit("rule-1")}
    )
    both = mapped.unionByName(branded)
    events = providers.post_envelopes(
        both.withColumn(
            "attributes",
            F.map_concat(
                F.map_filter("attributes", lambda k, _: k != "rule_id"),
                F.create_map(F.lit("rule_id"), F.col("rule_id")),
            ),
        )
    )
    kept = providers.consolidate_events(events, [F.desc(F.col("attributes")["rule_id"])])
    return kept.select(
        "tenant_id",
        F.col("source_object_id").alias("post_id"),
        F.col("attributes")["rule_id"].alias("rule_id"),
    )


_BOUND = """CASE WHEN tenant_id <> 't2' AND n % 3 = 0 THEN TIMESTAMP '2024-01-10'
  WHEN tenant_id <> 't2' AND n % 3 = 1 THEN TIMESTAMP '2024-01-11'
  ELSE TIMESTAMP '2024-01-28' END - INTERVAL 5 MINUTES"""


@query(
    "since_watermark",
    f"SELECT tenant_id, post_id, created_at FROM posts_v WHERE created_at >= {_BOUND}",
)
def since_watermark(spark, folder):
    rows = providers.map_x_posts(t.x_pages(spark, folder))
    fresh = cursors.since_watermark(
        rows, t.cursors(spark), t.AS_OF, lookback_hours=72, overlap_minutes=5
    )
    return t.plain(fresh.select("tenant_id", "post_id", "created_at"))


@query(
    "watermarks",
    f"""SELECT DISTINCT tenant_id, 'rule-' || (n % 3) AS rule_id, {_BOUND} AS lower_bound
    FROM posts_v""",
)
def watermarks(spark, folder):
    """Lower bounds of all rules that occur; a third of them have a cursor."""
    rules = t.x_pages(spark, folder).select("tenant_id", "source_id", "rule_id").distinct()
    bounds = cursors.watermarks(
        rules, t.cursors(spark), t.AS_OF, lookback_hours=72, overlap_minutes=5
    )
    return t.plain(bounds.select("tenant_id", "rule_id", "lower_bound"))


@query(
    "advance_cursors",
    """SELECT tenant_id, rule_id, CASE WHEN rule_id = 'rule-2' OR tenant_id = 't2'
        THEN TIMESTAMP '2024-01-31' WHEN rule_id = 'rule-1' THEN TIMESTAMP '2024-01-31'
        ELSE TIMESTAMP '2024-01-10' END AS cursor_at
    FROM (SELECT DISTINCT tenant_id, 'rule-' || (n % 3) AS rule_id FROM posts_v)
    WHERE NOT (rule_id = 'rule-0' AND tenant_id = 't2')""",
)
def advance_cursors(spark, folder):
    """The newest batch of rule 0 ends before its last page, so its cursor stays.

    An older batch with higher page numbers, read to its end, does not speak for it.
    """
    unread = F.replace(F.col("body"), F.lit('{"data"'), F.lit('{"meta":{"next_token":"n"},"data"'))
    pages = t.x_pages(spark, folder).withColumn(
        "body", F.when(F.col("rule_id") == "rule-0", unread).otherwise(F.col("body"))
    )
    older = t.x_pages(spark, folder).withColumns(
        {
            "page_no": F.col("page_no") + 1_000_000,
            "collected_at": F.col("collected_at") - F.expr("INTERVAL 1 DAY"),
        }
    )
    moved = cursors.advance_cursors(t.cursors(spark), pages.unionByName(older), t.AS_OF)
    return t.plain(moved.select("tenant_id", "rule_id", "cursor_at"))
