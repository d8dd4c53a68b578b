"""Library inputs derived from the given tables, as Spark columns.

``oracles.py`` states the same inputs in SQL. Every adapter reads its whole table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.identity import record_id
from tidemark.operators import posts as post_ops
from tidemark.sources.files import inline_values

# "Now" of the registered queries: the events end on 2024-01-30, the orders on 2001-07-31.
AS_OF = datetime(2024, 1, 31)
RUNS_AS_OF = datetime(2001, 8, 1)
TENANT = "t0"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table; zone-less timestamps become instants once, here."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Engine-neutral output types: zone-less times, dates and arrays as text, doubles
    rounded beyond their last meaningful digit."""

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(",", c)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def _pick(value: Column, *cases: tuple[object, Column | str | None], other: object = None):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, result in cases:
        out = out.when(value == key, F.lit(result) if isinstance(result, str) else result)
    return out.otherwise(F.lit(other).cast("string"))


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def seconds(n) -> Column:
    return F.make_dt_interval(secs=n if isinstance(n, Column) else F.lit(n))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """One post observation per event."""
    return _posts(spark, folder).drop("_kind", "_event", "_user")


def _posts(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    platform = _pick(e % 3, (0, "youtube"), (1, "reddit"), other="tiktok")
    text = _pick(
        kind,
        ("error", "Acme kettle issue: poor charging dock"),
        ("signup", "Week two of our balcony glow up"),
        ("purchase", "Acme setup notes that stay useful"),
        other="Rain on the harbour before noon",
    )
    hashtags = (
        F.when(kind == "signup", _strings("GlowUpChallenge", "BalconyWeek"))
        .when(kind == "purchase", _strings("KettleNotes", "SlowMornings"))
        .otherwise(_strings("HarbourWalks"))
    )
    place = _pick(
        F.col("user_id") % 5, (0, "PT-11"), (1, "PT-13"), (2, "PT-15"), (3, "NO-46"),
        other="IE-G",
    )
    events = load(spark, folder, "events")
    if spread:
        events = events.repartition("event_id", "ts", "user_id")
    return events.select(
        e.cast("string").alias("event_id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
        F.concat(F.lit("src-"), platform).alias("source_id"),
        F.concat(F.lit("corr-"), e).alias("correlation_id"),
        e.cast("string").alias("post_id"),
        platform.alias("platform"),
        F.col("user_id").cast("string").alias("author_id"),
        F.lit(0).cast("bigint").alias("author_followers"),
        text.alias("content_text"),
        hashtags.alias("hashtags"),
        F.when(kind == "signup", F.lit("audio_kiln")).alias("audio_id"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + seconds(e % 600)).alias("collected_at"),
        F.floor(F.col("value") * 100).alias("views"),
        F.get_json_object("props", "$.k").cast("bigint").alias("likes"),
        (e % 7).alias("comments"),
        (e % 5).alias("shares"),
        (e % 4).alias("saves"),
        F.lit("en").alias("language"),
        place.alias("geography"),
        F.when(kind.isin("error", "purchase"), F.lit("Acme")).alias("brand"),
        F.col("props").alias("source_payload"),
        F.col("props").alias("raw_event_payload"),
        (F.col("ts") + seconds(e % 600 + 60)).alias("ingested_at"),
        kind.alias("_kind"),
        e.alias("_event"),
        F.col("user_id").alias("_user"),
    )


def observed_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts plus later observations of every tenth one with one more view."""
    first = _posts(spark, folder)
    again = first.filter(F.col("_event") % 10 == 0).withColumns(
        {
            "event_id": F.concat(F.lit("r"), "event_id"),
            "collected_at": F.col("collected_at") + seconds(7200),
            "ingested_at": F.col("ingested_at") + seconds(7200),
            "views": F.col("views") + 1,
        }
    )
    return first.unionByName(again).drop("_kind", "_event", "_user")


def silver(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched posts as the fact queries read them (ids are unique already)."""
    return post_ops.enrich_posts(post_ops.canonical_posts(posts(spark, folder)))


def deliveries(spark: SparkSession, folder: str, full_payload: bool = False) -> DataFrame:
    """At-least-once deliveries with defects; every tenth event is delivered again.

    ``full_payload`` carries the post as JSON instead of the event's own props. That is many times the
    event's size, so the events are dealt out before it is made: their file may be one small row group.
    """
    e, user = F.col("_event"), F.col("_user")
    base = _posts(spark, folder, spread=full_payload)
    payload = F.col("source_payload")
    if full_payload:
        # As the output of a generator the JSON is opaque to constraint inference, which
        # would otherwise substitute its eighteen aliased columns in every combination.
        text = F.to_json(F.struct(*schemas.POST_PAYLOAD.names), schemas.JSON_TIMES)
        base = base.select("*", F.explode(F.array(text)).alias("_payload"))
        payload = F.col("_payload")
    first = base.select(
        "event_id",
        F.when(e % 97 == 0, F.lit("0.9")).otherwise(F.lit("1.0")).alias("schema_version"),
        F.when(e % 101 != 0, F.col("tenant_id")).alias("tenant_id"),
        F.when(e % 89 == 0, F.lit("src-unknown")).otherwise(F.col("source_id")).alias(
            "source_id"
        ),
        "platform",
        F.when(F.col("_kind") == "click", F.lit("social.post.updated"))
        .otherwise(F.lit("social.post.observed"))
        .alias("event_type"),
        F.col("post_id").alias("source_object_id"),
        F.col("created_at").alias("occurred_at"),
        "collected_at",
        F.when(e % 103 != 0, record_id((user % 3).cast("string"), "post_id")).alias(
            "idempotency_key"
        ),
        "correlation_id",
        F.when(e % 107 != 0, payload).alias("payload"),
        F.create_map(F.lit("delivery_mode"), F.lit("batch")).alias("attributes"),
        "ingested_at",
        e.alias("_event"),
    )
    again = first.filter(F.col("_event") % 10 == 0).withColumns(
        {
            "event_id": F.concat(F.lit("r"), "event_id"),
            "collected_at": F.col("collected_at") + seconds(7200),
            "ingested_at": F.col("ingested_at") + seconds(7200),
        }
    )
    return first.unionByName(again).drop("_event")


def contracts(spark: SparkSession) -> DataFrame:
    at = datetime(2024, 1, 1)
    return inline_values(
        spark,
        [
            ("1.0", "social.post.observed", "BACKWARD", "SOURCE_SHAPED_JSON", True, at),
            ("1.0", "social.post.updated", "BACKWARD", "SOURCE_SHAPED_JSON", True, at),
            ("0.9", "social.post.observed", "BACKWARD", "SOURCE_SHAPED_JSON", False, at),
        ],
        schemas.EVENT_CONTRACTS,
    )


def registry(spark: SparkSession) -> DataFrame:
    at = datetime(2024, 1, 1)
    rows = [
        (t, f"src-{p}", p, "demo", "batch", not (t == "t2" and p == "tiktok"), "1.0", 300,
         None, None, "data-platform", at)
        for t in ("t0", "t1", "t2")
        for p in ("youtube", "reddit", "tiktok")
    ]
    return inline_values(spark, rows, schemas.SOURCE_REGISTRY)


def trends(spark: SparkSession, folder: str) -> DataFrame:
    """Daily trend observations: how often each event type occurred per place."""
    return (
        load(spark, folder, "events")
        .groupBy(
            F.date_trunc("day", "ts").alias("observed_at"),
            F.col("event_type").alias("trend_name"),
            (F.col("user_id") % 5).alias("woeid"),
        )
        .agg(F.count(F.lit(1)).alias("tweet_count"))
        .select(
            F.lit(TENANT).alias("tenant_id"),
            F.lit("x-trends").alias("source_id"),
            F.lit("x").alias("platform"),
            "trend_name",
            "tweet_count",
            "woeid",
            F.concat(F.lit("place-"), "woeid").alias("location"),
            "observed_at",
            F.col("observed_at").alias("collected_at"),
            F.lit(None).cast("int").alias("trend_rank"),
            F.lit("{}").alias("source_payload"),
        )
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One connector run per order; the order priority names the source."""
    o = load(spark, folder, "orders")
    remaining = F.floor("o_totalprice") % 1000
    missing = F.lit(None).cast("bigint")
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"),
        F.col("o_orderpriority").alias("source_id"),
        F.lit("youtube").alias("platform"),
        F.lit("worker").alias("runtime"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderdate").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("FAILED"))
        .otherwise(F.lit("SUCCESS"))
        .alias("status"),
        (F.col("o_orderkey") % 4).alias("active_rules"),
        (F.col("o_orderkey") % 50).alias("videos_discovered"),
        missing.alias("posts_discovered"),
        missing.alias("trends_discovered"),
        (F.col("o_orderkey") % 80).alias("events_emitted"),
        (F.lit(1000) - remaining).alias("search_calls_used"),
        remaining.alias("search_calls_remaining"),
        (F.lit(10_000) - remaining * 10).alias("core_units_used"),
        (remaining * 10).alias("core_units_remaining"),
        missing.alias("requests_used"),
        missing.alias("requests_remaining"),
        F.lit("").alias("event_path"),
        F.lit("").alias("error_type"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    return load(spark, folder, "part").select(
        F.concat(F.lit("t"), p % 3).alias("tenant_id"),
        p.cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        (F.col("p_size") / 100).alias("gross_margin_rate"),
        F.lit(True).alias("active"),
        F.lit(AS_OF).alias("updated_at"),
    )


# Seed fits, audience and channel per signal; products by tenant.
SIGNAL_FITS = (
    ("battery_issue", 1.00, 0.70, "current customers", "owned-social", {"t0": "3", "t1": "1"}),
    (
        "product_tips", 0.90, 0.80, "consideration-stage shoppers", "paid-social",
        {"t0": "6", "t1": "4"},
    ),
    (
        "glow_up_challenge", 0.70, 0.75, "creator-led lifestyle audiences", "paid-social",
        {"t0": "9", "t1": "7"},
    ),
    (
        "glowupchallenge", 0.70, 0.75, "creator-led lifestyle audiences", "paid-social",
        {"t0": "9", "t1": "7"},
    ),
)


def signal_map(spark: SparkSession) -> DataFrame:
    rows = [
        (tenant, key, product, fit, commercial, audience, channel, True, AS_OF)
        for key, fit, commercial, audience, channel, mapped in SIGNAL_FITS
        for tenant, product in mapped.items()
    ]
    return inline_values(spark, rows, schemas.SIGNAL_PRODUCT_MAP)


# Lifecycle states by part key modulo 7, experiment states by modulo 5.
REC_STATES = (
    "PROPOSED", "APPROVED", "REJECTED", "EXPERIMENT_PLANNED", "RUNNING", "COMPLETED",
    "CANCELLED",
)
EXP_STATES = ("PLANNED", "RUNNING", "COMPLETED", "CANCELLED", "DRAFT")


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """One recommendation per part."""
    p = F.col("p_partkey")
    at = F.lit(datetime(2024, 1, 15))
    return load(spark, folder, "part").select(
        F.concat(F.lit("rec-"), p).alias("recommendation_id"),
        F.concat(F.lit("t"), p % 3).alias("tenant_id"),
        F.concat(F.lit("opp-"), p).alias("opportunity_id"),
        p.cast("string").alias("product_id"),
        F.lit("CREATIVE_TEST").alias("action_type"),
        F.lit("paid-social").alias("channel"),
        F.lit("shoppers").alias("target_audience"),
        F.concat(F.lit("Promote "), "p_name").alias("hypothesis"),
        F.concat(F.lit("Show "), "p_name").alias("creative_brief"),
        F.lit("conversion_rate").alias("primary_metric"),
        (F.col("p_size") * 2).cast("double").alias("confidence_score"),
        _pick(p % 7, *enumerate(REC_STATES)).alias("status"),
        F.when(p % 11 != 0, F.concat(F.lit("part:"), p)).otherwise(F.lit("")).alias(
            "evidence_ref"
        ),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(None).cast("string").alias("decided_by"),
        F.lit(None).cast("string").alias("decision_reason"),
    )


def experiments(spark: SparkSession, folder: str, completed: bool = False) -> DataFrame:
    """One experiment per part with line items; money in whole cents, so sums are exact."""
    k = F.col("l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")

    def total(flag: str) -> Column:
        return F.sum(F.when(F.col("l_returnflag") == flag, cents).otherwise(0)).cast("double")

    money = (
        load(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(
            total("N").alias("control_revenue"),
            total("A").alias("treatment_revenue"),
            total("R").alias("actual_spend"),
        )
    )
    recommendation = F.concat(F.lit("rec-"), k)
    at = F.lit(datetime(2024, 1, 20))
    nothing = F.lit(None)
    status = F.lit("COMPLETED") if completed else _pick(k % 5, *enumerate(EXP_STATES))
    return money.select(
        record_id(recommendation, F.lit("experiment-v1")).alias("experiment_id"),
        F.concat(F.lit("t"), k % 3).alias("tenant_id"),
        recommendation.alias("recommendation_id"),
        status.alias("status"),
        F.lit("conversion_rate").alias("primary_metric"),
        F.lit("contribution_margin").alias("guardrail_metric"),
        F.lit(10.0).alias("target_lift_pct"),
        F.lit("control").alias("control_definition"),
        F.lit("treatment").alias("treatment_definition"),
        F.lit(0.0).alias("planned_budget"),
        "actual_spend",
        nothing.cast("bigint").alias("control_conversions"),
        nothing.cast("bigint").alias("treatment_conversions"),
        "control_revenue",
        "treatment_revenue",
        nothing.cast("timestamp").alias("start_at"),
        nothing.cast("timestamp").alias("end_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def human_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels reviewed as posts: toxic means a high-risk battery issue."""
    toxic = F.col("toxic") == 1
    events = load(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"), "user_id", "ts"
    )
    platform = _pick(F.col("doc_id") % 3, (0, "youtube"), (1, "reddit"), other="tiktok")
    return (
        load(spark, folder, "labels")
        .join(events, "doc_id")
        .select(
            F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
            platform.alias("platform"),
            F.col("doc_id").cast("string").alias("post_id"),
            (F.col("ts") + seconds(86400)).alias("reviewed_at"),
            F.lit("reviewer").alias("reviewer_id"),
            F.when(toxic, F.lit("battery_issue")).otherwise(F.lit("lifestyle")).alias(
                "reviewed_topic"
            ),
            F.when(F.col("quality") == 1, F.lit("neutral"))
            .otherwise(F.lit("negative"))
            .alias("reviewed_sentiment"),
            F.when(toxic, F.lit("high")).otherwise(F.lit("none")).alias("reviewed_risk_level"),
            F.lit("").alias("review_notes"),
        )
    )


# --- provider pages ------------------------------------------------------------------

PAGE_ROWS = 100
JSON_Z = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_FIELDS = {"ignoreNullFields": "true"}


def _pages(items: DataFrame, wrap: Column) -> DataFrame:
    """Group provider objects into response pages of at most 100 objects.

    Event ids are unique, so a page number (id div 100) bounds the page for certain.
    """
    return items.groupBy("tenant_id", "source_id", "rule_id", "page_no").agg(
        F.to_json(wrap, _FIELDS).alias("body")
    ).withColumn("collected_at", F.lit(AS_OF))


def _z(ts: str) -> Column:
    return F.date_format(ts, JSON_Z)


def _provider_base(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return _posts(spark, folder).withColumns(
        {
            "source_id": F.lit(source),
            "rule_id": F.concat(F.lit("rule-"), F.col("_event") % 3),
            "page_no": F.expr(f"_event DIV {PAGE_ROWS}"),
        }
    )


def x_pages(spark: SparkSession, folder: str) -> DataFrame:
    """X search pages; posts of the signup kind carry entity tags, others only text."""
    text = F.concat("content_text", F.lit(" #Kiln #Letters"))
    item = F.struct(
        F.col("post_id").alias("id"),
        text.alias("text"),
        "author_id",
        _z("created_at").alias("created_at"),
        F.col("language").alias("lang"),
        F.struct(
            F.col("likes").alias("like_count"),
            F.col("comments").alias("reply_count"),
            F.col("shares").alias("retweet_count"),
            F.lit(2).alias("quote_count"),
            F.col("saves").alias("bookmark_count"),
            F.col("views").alias("impression_count"),
        ).alias("public_metrics"),
        F.when(
            F.col("audio_id").isNotNull(),
            F.struct(
                F.transform("hashtags", lambda h: F.struct(h.alias("tag"))).alias("hashtags")
            ),
        ).alias("entities"),
    )
    return _pages(
        _provider_base(spark, folder, "x-main").withColumn("item", item),
        F.struct(F.collect_list("item").alias("data")),
    )


def x_trend_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One trend response per place and day: the event types and their counts."""
    observed = trends(spark, folder)
    item = F.struct("trend_name", "tweet_count")
    return (
        observed.groupBy("tenant_id", "source_id", "woeid", "location", "collected_at")
        .agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("body"))
        .withColumns({"rule_id": F.lit("trend"), "page_no": F.lit(0)})
    )


def youtube_search_pages(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct(
        F.struct(F.col("post_id").alias("videoId")).alias("id"),
        F.struct(
            F.concat(F.lit("channel-"), "author_id").alias("channelId"),
            F.concat("content_text", F.lit(" #"), F.col("hashtags")[0]).alias("title"),
            F.when(F.col("brand").isNotNull(), F.lit("About #Acme")).alias("description"),
            _z("created_at").alias("publishedAt"),
        ).alias("snippet"),
    )
    return _pages(
        _provider_base(spark, folder, "yt-main").withColumn("item", item),
        F.struct(F.collect_list("item").alias("items")),
    )


def youtube_statistics_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the videos that have a place outside of PT (others are unknown)."""
    item = F.struct(
        F.col("post_id").alias("id"),
        F.struct(
            F.col("views").cast("string").alias("viewCount"),
            F.col("likes").cast("string").alias("likeCount"),
            F.col("comments").cast("string").alias("commentCount"),
        ).alias("statistics"),
    )
    known = _provider_base(spark, folder, "yt-main").filter(~F.col("geography").startswith("PT"))
    return _pages(known.withColumn("item", item), F.struct(F.collect_list("item").alias("items")))


def instagram_pages(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct(
        F.col("post_id").alias("id"),
        F.concat("content_text", F.lit(" #"), F.col("hashtags")[0]).alias("caption"),
        F.lit("REELS").alias("media_type"),
        F.lit("REELS").alias("media_product_type"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+0000'").alias("timestamp"),
        F.col("likes").alias("like_count"),
        F.col("comments").alias("comments_count"),
        F.col("views").alias("video_views"),
        F.concat(F.lit("https://example.org/reel/"), "post_id").alias("permalink"),
    )
    return _pages(
        _provider_base(spark, folder, "ig-main").withColumn("item", item),
        F.struct(F.collect_list("item").alias("data")),
    )


def instagram_account_pages(spark: SparkSession) -> DataFrame:
    rows = [
        (t, "ig-main", 0, AS_OF, f'{{"instagram_business_account":{{"id":"acct-{t}","username":"u-{t}"}}}}')
        for t in ("t0", "t1", "t2")
    ]
    schema = T.StructType.fromDDL(
        "tenant_id STRING, source_id STRING, page_no INT, collected_at TIMESTAMP, body STRING"
    )
    return inline_values(spark, rows, schema)


def _turn_item(likes: Column) -> Column:
    return F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.struct(
            F.struct(F.col("role").alias("value")).alias("authorChannelId"),
            F.col("text").alias("textOriginal"),
            likes.alias("likeCount"),
            F.lit("2024-01-10T00:00:00Z").alias("publishedAt"),
        ).alias("snippet"),
    )


def _thread_base(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "conversations").withColumns(
        {
            "tenant_id": F.concat(F.lit("t"), F.col("conv_id") % 3),
            "source_id": F.lit("yt-main"),
            "rule_id": F.lit("rule-0"),
            "page_no": F.expr("conv_id DIV 50"),
        }
    )


def thread_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Comment-thread pages: turn 0 is the comment, the later turns are its replies."""
    conversation = _thread_base(spark, folder)
    replies = conversation.groupBy("conv_id").agg(
        F.count_if(F.col("turn") > 0).alias("reply_count")
    )
    item = F.struct(
        F.concat(F.lit("thread-"), "conv_id").alias("id"),
        F.struct(
            F.concat(F.lit("video-"), "conv_id").alias("videoId"),
            F.col("reply_count").alias("totalReplyCount"),
            _turn_item(F.length("text") % 50).alias("topLevelComment"),
        ).alias("snippet"),
    )
    top = conversation.filter("turn = 0").join(replies, "conv_id").withColumn("item", item)
    return _pages(top, F.struct(F.collect_list("item").alias("items")))


def reply_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page per 100 replies of a thread, with the thread's video."""
    replies = (
        _thread_base(spark, folder)
        .filter("turn > 0")
        .withColumns(
            {
                "page_no": F.expr("turn DIV 100"),
                "rule_id": F.concat(F.lit("thread-"), "conv_id"),
                "item": _turn_item(F.length("text") % 50),
            }
        )
    )
    return _pages(replies, F.struct(F.collect_list("item").alias("items"))).withColumn(
        "video_id", F.replace("rule_id", F.lit("thread-"), F.lit("video-"))
    )


def cursors(spark: SparkSession) -> DataFrame:
    """Cursors of two of the three rules of tenant t0 and t1; the third has none."""
    rows = [
        (t, "x-main", f"rule-{i}", datetime(2024, 1, 10 + i), datetime(2024, 1, 20))
        for t in ("t0", "t1")
        for i in (0, 1)
    ]
    return inline_values(spark, rows, schemas.CURSORS)
