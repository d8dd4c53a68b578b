import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import envelope
from tidemark.sources import cursors, providers
from tidemark.sources.files import inline_values

AT = datetime(2026, 8, 8, 12)
PAGES = (
    "tenant_id STRING, source_id STRING, rule_id STRING, page_no INT, collected_at TIMESTAMP, "
    "body STRING"
)


@pytest.fixture
def pages(rows):
    def build(*bodies, rule="r", first=0):
        return rows(
            PAGES,
            *[("demo", "src", rule, first + i, AT, json.dumps(b)) for i, b in enumerate(bodies)],
        )

    return build


X_POST = {
    "id": "40217", "text": "Ferry timetable changes, see #HarbourNews", "author_id": "a-77",
    "created_at": "2025-03-02T06:17:09.000Z", "lang": "pt",
    "public_metrics": {
        "like_count": 31, "reply_count": 5, "retweet_count": 6, "quote_count": 4,
        "bookmark_count": 8, "impression_count": 2950,
    },
    "entities": {"hashtags": [{"tag": "HarbourNews"}, {"tag": " "}]},
}


def test_x_post(pages):
    row = providers.map_x_posts(pages({"data": [X_POST]})).first()
    assert (row.views, row.likes, row.comments, row.shares, row.saves) == (2950, 31, 5, 10, 8)
    assert (row.hashtags, row.author_id, row.language) == (["HarbourNews"], "a-77", "pt")
    assert row.created_at == datetime(2025, 3, 2, 6, 17, 9)
    assert row.attributes["rule_id"] == "r" and row.attributes["resource_type"] == "post"
    assert json.loads(row.source_payload) == X_POST
    assert list(json.loads(row.source_payload)) == sorted(X_POST)


def test_x_post_defaults(pages):
    bare = {"id": " 7 ", "text": "#b then #a #b", "created_at": "2025-03-02T06:17:09Z"}
    row = providers.map_x_posts(pages({"data": [bare, {"id": ""}]})).collect()
    assert len(row) == 1
    assert (row[0].post_id, row[0].author_id, row[0].language) == ("7", "unknown", "und")
    assert row[0].hashtags == ["b", "a", "b"] and row[0].views == 0


def test_first_page_wins(pages):
    changed = X_POST | {"text": "later"}
    rows = providers.map_x_posts(pages({"data": [X_POST]}, {"data": [changed, X_POST]})).collect()
    assert [r.content_text for r in rows] == [X_POST["text"]]


def test_a_later_batch_is_an_observation_of_its_own(pages):
    grown = X_POST | {"public_metrics": X_POST["public_metrics"] | {"impression_count": 9000}}
    later = pages({"data": [grown, X_POST]}).withColumn("collected_at", F.lit(datetime(2026, 8, 9)))
    rows = providers.map_x_posts(pages({"data": [X_POST]}).unionByName(later)).collect()
    assert {(r.collected_at, r.views) for r in rows} == {(AT, 2950), (datetime(2026, 8, 9), 9000)}


def test_statistics_of_the_own_batch_else_the_newest(pages):
    def at(df, day):
        return df.withColumn("collected_at", F.lit(datetime(2026, 8, day)))

    def stats(views):
        return {"items": [{"id": "vid-boat", "statistics": {"viewCount": views}}]}

    videos = at(pages({"items": [VIDEO]}), 1)
    for day in (2, 3):
        videos = videos.unionByName(at(pages({"items": [VIDEO]}), day))
    numbers = at(pages(stats("10"), stats("11")), 1).unionByName(at(pages(stats("20")), 3))
    rows = providers.map_youtube_videos(videos, numbers).collect()
    assert {r.collected_at.day: r.views for r in rows} == {1: 10, 2: 20, 3: 20}


def test_x_trends(pages):
    body = {"data": [
        {"trend_name": "Tide tables", "tweet_count": 36}, {"trend_name": " "},
        {"trend_name": "#Squall", "tweet_count": 811}, {"trend_name": "b", "tweet_count": 404},
        {"trend_name": "A", "tweet_count": 404},
    ]}
    place = pages(body).withColumns({"woeid": F.lit(7), "location": F.lit("Faro")})
    ranked = providers.map_x_trends(place, top_n=4)
    rows = ranked.orderBy("trend_rank").collect()
    assert [r.trend_name for r in rows] == ["#Squall", "A", "b", "Tide tables"]
    assert rows[0].attributes["trend_rank"] == "1"
    assert rows[0].source_object_id.startswith("trend:7:")
    assert len(rows[0].source_object_id) == len("trend:7:") + 20
    parsed = envelope.parse_trend_payload(
        providers.trend_envelopes(ranked).withColumn("ingested_at", F.lit(AT))
    )
    assert {(r.trend_name, r.trend_rank, r.woeid) for r in parsed.collect()} == {
        ("#Squall", 1, 7), ("A", 2, 7), ("b", 3, 7), ("Tide tables", 4, 7),
    }


VIDEO = {
    "id": {"videoId": "vid-boat"},
    "snippet": {
        "channelId": "chan-sail", "title": "Splicing rope, part two #Rigging",
        "description": "Eye splices on three-strand rope. #Rigging",
        "publishedAt": "2025-02-11T19:05:00Z",
    },
}
STATISTICS = {
    "id": "vid-boat",
    "statistics": {"viewCount": "6310", "likeCount": "227", "commentCount": "19"},
}


def test_youtube_video(pages):
    found = pages({"items": [VIDEO, VIDEO | {"id": {"videoId": "lonely"}}]})
    rows = providers.map_youtube_videos(found, pages({"items": [STATISTICS]}))
    got = {r.post_id: r for r in rows.collect()}
    row = got["vid-boat"]
    assert (row.views, row.likes, row.comments, row.shares) == (6310, 227, 19, 0)
    assert row.content_text.split("\n")[0] == VIDEO["snippet"]["title"]
    assert row.hashtags == ["Rigging"] and row.author_id == "chan-sail"
    assert (row.language, row.geography) == ("en", "US")
    assert (got["lonely"].views, got["lonely"].likes) == (0, 0)


def comment(key, likes, **more):
    snippet = {
        "authorChannelId": {"value": f"author-{key}"}, "textOriginal": f"{key} #Knots",
        "likeCount": likes, "publishedAt": "2025-02-12T08:40:00Z",
    }
    return {"id": key, "snippet": snippet | more}


def test_youtube_comment_and_reply(pages):
    thread = {
        "id": "t", "snippet": {
            "videoId": "vid-boat", "totalReplyCount": 1, "topLevelComment": comment("c1", 7)},
    }
    top = providers.map_youtube_comments(pages({"items": [thread, {"id": "t2"}]})).collect()
    assert len(top) == 1
    assert (top[0].post_id, top[0].likes, top[0].comments, top[0].views) == ("c1", 7, 1, 0)
    assert top[0].attributes["comment_type"] == "top_level"
    assert top[0].attributes["parent_video_id"] == "vid-boat"
    reply_page = pages({"items": [comment("r1", 2), comment("r2", 0, authorChannelId=None)]})
    replies = providers.map_youtube_replies(reply_page.withColumn("video_id", F.lit("vid-boat")))
    got = {r.post_id: r for r in replies.collect()}
    assert (got["r1"].likes, got["r1"].author_id) == (2, "author-r1")
    assert got["r2"].author_id == "unknown"
    assert got["r1"].attributes["comment_type"] == "reply" and got["r1"].hashtags == ["Knots"]


def test_instagram_media(pages):
    media = {
        "id": "m-5", "caption": "Low water at dawn. #Mudflats #Waders",
        "media_type": "REELS", "timestamp": "2025-03-02T07:17:09+0100", "like_count": 14,
        "comments_count": 3, "video_views": 460, "permalink": "https://example.org/p",
    }
    account = {"instagram_business_account": {"id": "acct-9", "username": "tideline"}, "id": "1"}
    accounts = providers.linked_accounts(pages(account, {"id": "2"}))
    row = providers.map_instagram_media(
        pages({"data": [media, {"id": "no time"}]}), accounts
    ).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.views, row.likes, row.comments) == (460, 14, 3)
    assert row.hashtags == ["Mudflats", "Waders"]
    assert (row.author_id, row.author_username) == ("acct-9", "tideline")
    assert row.created_at == datetime(2025, 3, 2, 6, 17, 9) and row.media_type == "REELS"


def test_media_without_account_go_aside(pages):
    late = {"id": "m-5", "timestamp": "2025-03-02T07:17:09+0100"}
    media = pages({"data": [{"id": "m-5"}, late]})
    none = providers.linked_accounts(pages({"id": "2"}))
    assert providers.map_instagram_media(media, none).isEmpty()
    aside = providers.unlinked_media(media, none).collect()
    assert [(r.object_id, r.reason) for r in aside] == [("m-5", "missing_linked_account")]
    linked = [{"instagram_business_account": {"id": k}} for k in ("b", "a")]
    accounts = providers.linked_accounts(pages(*linked))
    assert [r.account_id for r in accounts.collect()] == ["b"]
    kept = providers.map_instagram_media(media, accounts).collect()
    assert [r.created_at for r in kept] == [datetime(2025, 3, 2, 6, 17, 9)]
    assert providers.unlinked_media(media, accounts).isEmpty()


def test_one_event_for_an_object_of_two_rules(pages):
    both = pages({"data": [X_POST]}, rule="a").unionByName(pages({"data": [X_POST]}, rule="b"))
    events = providers.post_envelopes(providers.map_x_posts(both))
    assert events.count() == 2 and events.select("idempotency_key").distinct().count() == 1
    kept = providers.consolidate_events(events, [F.desc(F.col("attributes")["rule_id"])])
    assert [r.attributes["rule_id"] for r in kept.collect()] == ["b"]


def test_next_page_token(pages):
    bodies = [
        {"meta": {"next_token": "n"}}, {"nextPageToken": " y "},
        {"paging": {"cursors": {"after": "a"}}}, {"meta": {"next_token": " "}}, {},
    ]
    got = pages(*bodies).select(providers.next_page_token(F.col("body")).alias("t")).collect()
    assert [r.t for r in got] == ["n", "y", "a", None, None]


def cursor(rule, at):
    return ("demo", "src", rule, at, at)


def test_lower_bounds(spark, rows):
    known = inline_values(spark, [cursor("r", datetime(2026, 8, 8, 11, 50))], schemas.CURSORS)
    rules = rows("tenant_id STRING, source_id STRING, rule_id STRING",
                 ("demo", "src", "r"), ("demo", "src", "new"))
    got = {r.rule_id: r.lower_bound for r in cursors.watermarks(rules, known, AT).collect()}
    assert got == {"r": datetime(2026, 8, 8, 11, 45), "new": datetime(2026, 8, 7, 11, 55)}
    seen = rows(
        "tenant_id STRING, source_id STRING, rule_id STRING, created_at TIMESTAMP",
        ("demo", "src", "r", datetime(2026, 8, 8, 11, 45)),
        ("demo", "src", "r", datetime(2026, 8, 8, 11, 44, 59)),
    )
    assert cursors.since_watermark(seen, known, AT).count() == 1


def test_unread_page_keeps_the_cursor(spark, pages):
    start = datetime(2026, 8, 1)
    known = inline_values(spark, [cursor("a", start), cursor("b", start)], schemas.CURSORS)
    unread = {"data": [], "meta": {"next_token": "n"}}
    landed = pages(unread, {"data": []}, rule="a").unionByName(pages(unread, rule="b"))
    landed = landed.unionByName(pages({"data": []}, rule="new"))
    # An older batch of rule b went further, to its end; the newest one still decides.
    older = pages({"data": []}, rule="b", first=9).withColumn("collected_at", F.lit(start))
    landed = landed.unionByName(older)

    def moved(**options):
        after = cursors.advance_cursors(known, landed, AT, **options)
        return {r.rule_id: r.cursor_at for r in after.collect()}

    assert moved() == {"a": AT, "b": start, "new": AT}
    assert moved(guard=False) == {"a": AT, "b": AT, "new": AT}
