"""Provider JSON pages to canonical post and trend payloads.

Landed pages have (tenant_id, source_id, rule_id, page_no, collected_at, body), one JSON
response per row. The pages that one collection run of a rule landed share its
``collected_at``: that is the batch. An object counts once per batch, and every batch is an
observation of its own. Pages are exploded to raw object texts, so that every mapped row keeps
its provider object whole in ``source_payload``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.identity import is_blank, strip
from tidemark.functions.scoring import nonneg_int
from tidemark.functions.text import extract_hashtags, sorted_json
from tidemark.operators.envelope import build_envelope
from tidemark.operators.rows import latest_per_group

PAGE_KEYS = ("tenant_id", "source_id", "rule_id", "page_no", "collected_at")
BATCH = ["tenant_id", "source_id", "rule_id", "collected_at"]
PAYLOAD_FIELDS = tuple(schemas.POST_PAYLOAD.names)
TREND_FIELDS = tuple(schemas.TREND_PAYLOAD.names)
POST_EVENT = "social.post.observed"
TREND_EVENT = "social.trend.observed"

X_POST = """
    id STRING, text STRING, author_id STRING, created_at TIMESTAMP, lang STRING,
    public_metrics STRUCT<like_count: STRING, reply_count: STRING, retweet_count: STRING,
        quote_count: STRING, bookmark_count: STRING, impression_count: STRING>,
    entities STRUCT<hashtags: ARRAY<STRUCT<tag: STRING>>>
"""
X_TREND = "trend_name STRING, tweet_count STRING"
YOUTUBE_VIDEO = """
    id STRUCT<videoId: STRING>,
    snippet STRUCT<channelId: STRING, title: STRING, description: STRING,
        publishedAt: TIMESTAMP, defaultLanguage: STRING, defaultAudioLanguage: STRING>
"""
YOUTUBE_STATISTICS = """
    id STRING,
    statistics STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>
"""
YOUTUBE_COMMENT = """
    id STRING,
    snippet STRUCT<authorChannelId: STRING, textOriginal: STRING, textDisplay: STRING,
        likeCount: STRING, publishedAt: TIMESTAMP>
"""
YOUTUBE_THREAD = f"""
    id STRING,
    snippet STRUCT<videoId: STRING, totalReplyCount: STRING,
        topLevelComment: STRUCT<{YOUTUBE_COMMENT.replace("id STRING", "id: STRING").replace(
            "snippet STRUCT", "snippet: STRUCT")}>>
"""
INSTAGRAM_MEDIA = """
    id STRING, caption STRING, media_type STRING, media_product_type STRING,
    timestamp STRING, like_count STRING, comments_count STRING, video_views STRING,
    permalink STRING
"""


def next_page_token(body: Column) -> Column:
    """Token of the unread next page of any provider; NULL on the last page."""
    paths = ("$.meta.next_token", "$.nextPageToken", "$.paging.cursors.after")
    found = F.coalesce(
        *[F.nullif(strip(F.get_json_object(body, p)), F.lit("")) for p in paths]
    )
    return found


def _raw_items(pages: DataFrame, items: str, positions: bool = False) -> DataFrame:
    """One row per object text of the pages' ``items`` array; the other columns stay."""
    kept = [c for c in pages.columns if c != "body"]
    texts = F.from_json("body", f"{items} ARRAY<STRING>")[items]
    if positions:
        return pages.select(*kept, F.posexplode(texts).alias("_pos", "raw"))
    return pages.select(*kept, F.explode(texts).alias("raw"))


def _parse_once(rows: DataFrame, object_schema: str) -> DataFrame:
    """Add the parsed ``item``. As a generator the parse is not repeated by filters."""
    parsed = F.from_json("raw", object_schema)
    return rows.select("*", F.explode(F.array(parsed)).alias("item"))


def explode_provider_pages(
    pages: DataFrame, items: str, object_schema: str, object_id: str, required: str | None = None
) -> DataFrame:
    """One row per provider object and batch: the first occurrence of an id in it.

    ``items`` is the page's array field (``data`` or ``items``), ``object_id`` the path of
    the id inside an object; objects with a blank ``required`` path do not count. Adds ``object_id``, ``raw`` and the parsed ``item``. Only the
    id is read before the shuffle and only ``raw`` travels; the objects that stay are
    parsed behind it.
    """
    key = strip(F.get_json_object("raw", f"$.{object_id}"))
    keyed = (
        _raw_items(pages, items, positions=True)
        .select("*", F.explode(F.array(key)).alias("object_id"))
        .filter(~is_blank(F.col("object_id")))
    )
    if required:
        keyed = keyed.filter(~is_blank(F.get_json_object("raw", f"$.{required}")))
    first = latest_per_group(
        keyed, [*BATCH, "object_id"], [F.asc("page_no"), F.asc("_pos"), F.asc("raw")]
    )
    return first.drop("_pos").withColumn("item", F.from_json("raw", object_schema))


def _canonical(
    rows: DataFrame,
    fields: dict[str, Column],
    attributes: dict[str, Column],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Select the canonical payload columns with page keys and delivery attributes."""
    defaults = {
        "author_followers": F.lit(0).cast("bigint"),
        "audio_id": F.lit(None).cast("string"),
        "shares": F.lit(0).cast("bigint"),
        "saves": F.lit(0).cast("bigint"),
        "brand": F.lit(None).cast("string"),
        "geography": F.lit(None).cast("string"),
        "collected_at": F.col("collected_at"),
        "source_payload": sorted_json(F.col("raw")),
    }
    columns = {**defaults, **fields}
    pairs = [
        part
        for name, value in (*attributes.items(), ("rule_id", F.col("rule_id")))
        for part in (F.lit(name), value)
    ]
    return rows.select(
        "tenant_id",
        "source_id",
        "rule_id",
        *[columns[name].alias(name) for name in PAYLOAD_FIELDS],
        *[c.alias(name) for name, c in (extra or {}).items()],
        F.create_map(*pairs).alias("attributes"),
    )


def _delivery(connector: str, resource: str, **more: Column) -> dict[str, Column]:
    return {
        "connector_type": F.lit(connector),
        "delivery_mode": F.lit("polling"),
        "resource_type": F.lit(resource),
        **more,
    }


def map_x_posts(pages: DataFrame) -> DataFrame:
    """X search pages to canonical posts; entity tags win over tags in the text."""
    rows = explode_provider_pages(pages, "data", X_POST, "id")
    item, metrics = F.col("item"), F.col("item.public_metrics")
    text = F.coalesce(item["text"], F.lit(""))
    tags = F.filter(
        F.transform(item["entities"]["hashtags"], lambda t: t["tag"]), lambda t: ~is_blank(t)
    )
    fields = {
        "post_id": F.col("object_id"),
        "platform": F.lit("x"),
        "author_id": F.coalesce(F.nullif(item["author_id"], F.lit("")), F.lit("unknown")),
        "content_text": text,
        "hashtags": F.when(F.size(tags) > 0, tags).otherwise(
            extract_hashtags(text, distinct=False)
        ),
        "created_at": item["created_at"],
        "views": nonneg_int(metrics["impression_count"]),
        "likes": nonneg_int(metrics["like_count"]),
        "comments": nonneg_int(metrics["reply_count"]),
        "shares": nonneg_int(metrics["retweet_count"]) + nonneg_int(metrics["quote_count"]),
        "saves": nonneg_int(metrics["bookmark_count"]),
        "language": F.coalesce(item["lang"], F.lit("und")),
    }
    return _canonical(rows, fields, _delivery("x_api_v2_recent_search", "post"))


def rank_trends(trends: DataFrame, keys: Sequence[str], top_n: int) -> DataFrame:
    """Number trends from 1 by falling count, then by name without case; keep ``top_n``."""
    window = Window.partitionBy(*keys).orderBy(
        F.desc("tweet_count"), F.lower("trend_name"), F.col("trend_name")
    )
    return trends.withColumn("trend_rank", F.row_number().over(window)).filter(
        F.col("trend_rank") <= top_n
    )


def map_x_trends(pages: DataFrame, top_n: int = 20) -> DataFrame:
    """Trend pages (with ``woeid`` and ``location`` columns) to ranked trend payloads."""
    rows = (
        _parse_once(_raw_items(pages, "data"), X_TREND)
        .withColumn("trend_name", strip(F.col("item.trend_name")))
        .filter(~is_blank(F.col("trend_name")))
        .withColumn("tweet_count", nonneg_int(F.col("item.tweet_count")))
        .drop("item")
    )
    ranked = rank_trends(rows, ["tenant_id", "source_id", "woeid", "collected_at"], top_n)
    name_hash = F.substring(F.sha2(F.lower("trend_name"), 256), 1, 20)
    return ranked.select(
        "tenant_id",
        "source_id",
        "rule_id",
        F.concat_ws(":", F.lit("trend"), F.col("woeid").cast("string"), name_hash).alias(
            "source_object_id"
        ),
        F.lit("x").alias("platform"),
        "trend_name",
        "tweet_count",
        "woeid",
        "location",
        F.col("collected_at").alias("observed_at"),
        sorted_json(F.col("raw")).alias("source_payload"),
        F.create_map(
            F.lit("connector_type"), F.lit("x_api_v2_trends_by_woeid"),
            F.lit("delivery_mode"), F.lit("polling"),
            F.lit("resource_type"), F.lit("trend"),
            F.lit("trend_woeid"), F.col("woeid").cast("string"),
            F.lit("trend_location"), F.col("location"),
            F.lit("trend_rank"), F.col("trend_rank").cast("string"),
        ).alias("attributes"),
        "trend_rank",
    )


def attach_video_stats(videos: DataFrame, statistics_pages: DataFrame) -> DataFrame:
    """Exploded search rows with the statistics of their video; unknown ones stay.

    A row takes the statistics that its own batch collected. Without them it takes the
    newest ones by time, then by page.
    """
    video = ["tenant_id", "source_id", "object_id"]
    found = explode_provider_pages(statistics_pages, "items", YOUTUBE_STATISTICS, "id")
    found = found.select(*video, "collected_at", "page_no", "rule_id", "item.statistics")
    order = [F.desc("page_no"), F.desc("rule_id")]
    own = latest_per_group(found, [*video, "collected_at"], order)
    newest = latest_per_group(found, video, [F.desc("collected_at"), *order])
    own = own.select(*video, "collected_at", F.col("statistics").alias("_own"))
    newest = newest.select(*video, F.col("statistics").alias("_newest"))
    rows = videos.join(own, [*video, "collected_at"], "left").join(newest, video, "left")
    return rows.withColumn("statistics", F.coalesce("_own", "_newest")).drop("_own", "_newest")


def map_youtube_videos(
    search_pages: DataFrame,
    statistics_pages: DataFrame,
    language: str = "en",
    region: str = "US",
) -> DataFrame:
    """Search pages with statistics to canonical posts; text is title, then description."""
    found = explode_provider_pages(search_pages, "items", YOUTUBE_VIDEO, "id.videoId")
    rows = attach_video_stats(found, statistics_pages)
    snippet, stats = F.col("item.snippet"), F.col("statistics")
    title = F.nullif(F.coalesce(snippet["title"], F.lit("")), F.lit(""))
    description = F.nullif(F.coalesce(snippet["description"], F.lit("")), F.lit(""))
    spoken = [
        F.nullif(snippet[name], F.lit("")) for name in ("defaultLanguage", "defaultAudioLanguage")
    ]
    fields = {
        "post_id": F.col("object_id"),
        "platform": F.lit("youtube"),
        "author_id": F.coalesce(snippet["channelId"], F.lit("")),
        "content_text": strip(F.concat_ws("\n", title, description)),
        "hashtags": extract_hashtags(title, description),
        "created_at": snippet["publishedAt"],
        "views": nonneg_int(stats["viewCount"]),
        "likes": nonneg_int(stats["likeCount"]),
        "comments": nonneg_int(stats["commentCount"]),
        "language": F.coalesce(*spoken, F.lit(language)),
        "geography": F.lit(region),
    }
    return _canonical(rows, fields, _delivery("youtube_data_api_v3", "video"))


def _comment_fields(
    comment: Column, replies: Column, language: str, region: str
) -> dict[str, Column]:
    snippet = comment["snippet"]
    author = snippet["authorChannelId"]
    author_id = F.when(
        author.startswith("{"), F.get_json_object(author, "$.value")
    ).otherwise(author)
    text = F.coalesce(
        F.nullif(snippet["textOriginal"], F.lit("")), snippet["textDisplay"], F.lit("")
    )
    return {
        "post_id": strip(comment["id"]),
        "platform": F.lit("youtube"),
        "author_id": F.coalesce(F.nullif(author_id, F.lit("")), F.lit("unknown")),
        "content_text": text,
        "hashtags": extract_hashtags(text),
        "created_at": snippet["publishedAt"],
        "views": F.lit(0).cast("bigint"),
        "likes": nonneg_int(snippet["likeCount"]),
        "comments": replies,
        "language": F.lit(language),
        "geography": F.lit(region),
    }


def map_youtube_comments(
    thread_pages: DataFrame, language: str = "en", region: str = "US"
) -> DataFrame:
    """Comment-thread pages to one canonical post per top-level comment."""
    rows = _parse_once(_raw_items(thread_pages, "items"), YOUTUBE_THREAD).filter(
        ~is_blank(F.col("item.snippet.topLevelComment.id"))
    )
    snippet = F.col("item.snippet")
    fields = _comment_fields(
        snippet["topLevelComment"], nonneg_int(snippet["totalReplyCount"]), language, region
    )
    attributes = _delivery(
        "youtube_data_api_v3",
        "comment",
        comment_type=F.lit("top_level"),
        parent_video_id=snippet["videoId"],
    )
    return _canonical(rows, fields, attributes)


def map_youtube_replies(
    reply_pages: DataFrame, language: str = "en", region: str = "US"
) -> DataFrame:
    """Reply pages (with a ``video_id`` column) to canonical posts."""
    rows = _parse_once(_raw_items(reply_pages, "items"), YOUTUBE_COMMENT).filter(
        ~is_blank(F.col("item.id"))
    )
    fields = _comment_fields(F.col("item"), F.lit(0).cast("bigint"), language, region)
    attributes = _delivery(
        "youtube_data_api_v3",
        "comment",
        comment_type=F.lit("reply"),
        parent_video_id=F.col("video_id"),
    )
    return _canonical(rows, fields, attributes)


def linked_accounts(account_pages: DataFrame) -> DataFrame:
    """Business account behind each configured page; pages without one give no row.

    A source with several linked pages takes the newest, then the first page's account.
    """
    account = F.from_json(
        "body", "instagram_business_account STRUCT<id: STRING, username: STRING>"
    )["instagram_business_account"]
    linked = (
        account_pages.select(
            "tenant_id", "source_id", "collected_at", "page_no", account.alias("account")
        )
        .filter(~is_blank(F.col("account.id")))
        .select(
            "tenant_id",
            "source_id",
            F.col("account.id").alias("account_id"),
            F.coalesce("account.username", F.lit("")).alias("username"),
            "collected_at",
            "page_no",
        )
    )
    order = [F.desc("collected_at"), F.asc("page_no"), F.asc("account_id"), F.asc("username")]
    chosen = latest_per_group(linked, ["tenant_id", "source_id"], order)
    return chosen.drop("collected_at", "page_no")


def _media(media_pages: DataFrame) -> DataFrame:
    return explode_provider_pages(media_pages, "data", INSTAGRAM_MEDIA, "id", "timestamp")


def unlinked_media(media_pages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Media of sources without a linked account: what ``map_instagram_media`` cannot map."""
    rows = _media(media_pages).join(accounts, ["tenant_id", "source_id"], "left_anti")
    reason = F.lit("missing_linked_account").alias("reason")
    return rows.select(*PAGE_KEYS, "object_id", "raw", reason)


def map_instagram_media(media_pages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Media pages and their linked accounts to canonical posts with permalink and type.

    Media of sources without an account are left to ``unlinked_media``.
    """
    rows = _media(media_pages).join(accounts, ["tenant_id", "source_id"], "inner")
    item = F.col("item")
    caption = F.coalesce(item["caption"], F.lit(""))
    # Offsets come without a colon ("+0000"), which ISO parsing does not take.
    with_colon = F.regexp_replace(item["timestamp"], r"([+-]\d{2})(\d{2})$", "$1:$2")

    def text_of(name: str) -> Column:
        return F.coalesce(item[name], F.lit(""))

    fields = {
        "post_id": F.col("object_id"),
        "platform": F.lit("instagram"),
        "author_id": F.col("account_id"),
        "content_text": caption,
        "hashtags": extract_hashtags(caption, distinct=False),
        "created_at": with_colon.try_cast("timestamp"),
        "views": nonneg_int(item["video_views"]),
        "likes": nonneg_int(item["like_count"]),
        "comments": nonneg_int(item["comments_count"]),
        "language": F.lit("und"),
    }
    extra = {
        "author_username": F.col("username"),
        "permalink": text_of("permalink"),
        "media_type": text_of("media_type"),
        "media_product_type": text_of("media_product_type"),
    }
    return _canonical(rows, fields, _delivery("instagram_graph_api", "media"), extra)


def post_envelopes(mapped: DataFrame) -> DataFrame:
    """Envelopes of canonical posts, ready to land."""
    payload = [c for c in mapped.columns if c not in ("tenant_id", "source_id", "rule_id",
                                                      "attributes")]
    return build_envelope(
        mapped,
        tenant_id=F.col("tenant_id"),
        source_id=F.col("source_id"),
        platform=F.col("platform"),
        event_type=F.lit(POST_EVENT),
        source_object_id=F.col("post_id"),
        occurred_at=F.col("created_at"),
        collected_at=F.col("collected_at"),
        payload=F.to_json(F.struct(*payload), schemas.JSON_TIMES),
        attributes=F.col("attributes"),
    )


def trend_envelopes(mapped: DataFrame) -> DataFrame:
    """Envelopes of ranked trends, ready to land."""
    return build_envelope(
        mapped,
        tenant_id=F.col("tenant_id"),
        source_id=F.col("source_id"),
        platform=F.col("platform"),
        event_type=F.lit(TREND_EVENT),
        source_object_id=F.col("source_object_id"),
        occurred_at=F.col("observed_at"),
        collected_at=F.col("observed_at"),
        payload=F.to_json(F.struct(*TREND_FIELDS), schemas.JSON_TIMES),
        attributes=F.col("attributes"),
    )


def consolidate_events(events: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One event per logical key when several rules found the same object.

    ``order`` puts the winning delivery first, e.g. the rule that ran last.
    """
    return latest_per_group(events, ["tenant_id", "idempotency_key"], order)
