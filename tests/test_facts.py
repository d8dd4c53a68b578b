from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, metrics, posts, signals
from tidemark.queries import tables as t

AT = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def hourly(rows, counts, topic="a", tenant="t0"):
    return rows(
        "tenant_id STRING, topic STRING, hour_ts TIMESTAMP, post_count BIGINT, "
        "creator_count BIGINT, platform_count BIGINT, engagements BIGINT, positive_share DOUBLE",
        *[(tenant, topic, AT + i * HOUR, n, 1, 1, n, 0.0) for i, n in counts],
    )


def test_first_hour_has_no_baseline(rows):
    row = metrics.trend_hourly(hourly(rows, [(0, 5)])).first()
    assert row.baseline_posts is None and row.previous_posts is None
    assert (row.velocity_z, row.acceleration_pct, row.novelty) == (0.0, 0.0, 1.0)


def test_baseline_counts_rows_not_hours(rows):
    sparse = [(i * 10, 4) for i in range(30)] + [(301, 8)]
    last = metrics.trend_components(hourly(rows, sparse)).orderBy(F.desc("hour_ts")).first()
    assert (last.baseline_posts, last.baseline_post_stddev) == (4.0, 0.0)
    assert last.velocity_z == 0.0 and last.acceleration_pct == 1.0 and last.novelty == 0.0


def test_snapshot_takes_each_topics_latest_hour(rows):
    df = hourly(rows, [(0, 1), (2, 3)]).unionByName(hourly(rows, [(1, 7)], topic="b"))
    got = {r.topic: r.post_count for r in metrics.trend_snapshot(df).collect()}
    assert got == {"a": 3, "b": 7}


def test_posts_without_hashtags_never_count_as_challenges(rows):
    df = rows(
        "tenant_id STRING, created_at TIMESTAMP, author_id STRING, geography STRING, "
        "platform STRING, audio_id STRING, hashtags ARRAY<STRING>",
        ("t0", AT, "a", "g", "x", "audio", []),
        ("t0", AT, "a", "g", "x", "audio", ["Song"]),
        ("t0", AT, "b", "g", "x", None, ["MyChallenge", "other"]),
    )
    got = {r.challenge_name: r.participation_count for r in metrics.challenge_hourly(df).collect()}
    assert got == {"song": 1, "mychallenge": 1}


def test_scores_of_all_hours_are_bounded(spark, folder):
    silver = t.silver(spark, folder)
    trends = metrics.trend_hourly(metrics.topic_hourly(silver))
    challenges = metrics.challenge_hourly(silver)
    assert trends.filter("trend_score is null or trend_score not between 0 and 100").isEmpty()
    assert challenges.filter("challenge_score not between 0 and 100").isEmpty()


def test_dedup_posts_is_idempotent(spark, folder):
    once = posts.dedup_posts(t.observed_posts(spark, folder))
    assert posts.dedup_posts(once).count() == once.count() == t.posts(spark, folder).count()
    assert once.filter("event_id like 'r%'").count() > 0


def test_review_queue_keeps_fifty_per_stratum(spark, folder, plan_of):
    queue = posts.review_queue(t.silver(spark, folder), 5)
    sizes = queue.groupBy("tenant_id", "review_priority").count()
    assert sizes.filter("count > 5").isEmpty() and sizes.count() == 6
    assert "WindowGroupLimit" in plan_of(queue)


def test_trending_topics_keep_ties_and_null_platforms(rows):
    df = rows(
        "tenant_id STRING, source_id STRING, platform STRING, woeid BIGINT, location STRING, "
        "trend_name STRING, tweet_count BIGINT, trend_rank INT, observed_at TIMESTAMP, "
        "collected_at TIMESTAMP, source_payload STRING",
        ("t", "s", None, 1, "l", "old", 1, 1, AT, AT, ""),
        ("t", "s", None, 1, "l", "a", 1, 1, AT + HOUR, AT, ""),
        ("t", "s", None, 1, "l", "b", 1, 2, AT + HOUR, AT, ""),
        ("t", "s", "x", 2, "l", "c", 1, 1, AT, AT, ""),
    )
    got = {r.trend_name for r in metrics.trending_topics(df, AT).collect()}
    assert got == {"a", "b", "c"}


def delivery(rows, *latencies, source="s"):
    return rows(
        "tenant_id STRING, source_id STRING, idempotency_key STRING, occurred_at TIMESTAMP, "
        "collected_at TIMESTAMP, ingested_at TIMESTAMP",
        *[
            ("t", source, f"k{i // 2}", AT, AT + timedelta(seconds=s), AT + HOUR)
            for i, s in enumerate(latencies)
        ],
    )


def test_delivery_percentile_is_the_first_covering_second(rows):
    row = health.source_delivery(delivery(rows, *range(1, 101))).first()
    assert row.collection_latency_p95_seconds == 95
    assert (row.delivered_events, row.unique_logical_events, row.duplicate_deliveries) == (
        100, 50, 50,
    )
    early = health.source_delivery(delivery(rows, -5, -5, -5)).first()
    assert early.collection_latency_p95_seconds == 0


def registry(rows, *sources):
    return rows(
        "tenant_id STRING, source_id STRING, platform STRING, connector_type STRING, "
        "collection_mode STRING, enabled BOOLEAN, poll_interval_seconds INT",
        *[("t", name, "x", "c", "m", enabled, poll) for name, enabled, poll in sources],
    )


@pytest.mark.parametrize(
    ("seconds", "poll", "status"),
    [(900, 100, "HEALTHY"), (901, 100, "STALE"), (901, None, "STALE"), (1200, 400, "HEALTHY")],
)
def test_health_threshold(rows, seconds, poll, status):
    df = delivery(rows, 0)
    none = rows("tenant_id STRING, source_id STRING", ("t", "other"))
    row = health.source_health(
        df, none, registry(rows, ("s", True, poll)), AT + timedelta(seconds=seconds)
    ).first()
    assert row.health_status == status


def test_health_states(rows):
    df = delivery(rows, 0).unionByName(delivery(rows, 0, source="bad"))
    rejected = rows("tenant_id STRING, source_id STRING", ("t", "bad"))
    sources = registry(rows, ("s", True, 60), ("bad", True, 60), ("off", False, 60), ("new", True, 60))
    got = {
        r.source_id: (r.health_status, r.delivered_events, r.rejected_events)
        for r in health.source_health(df, rejected, sources, AT).collect()
    }
    assert got == {
        "s": ("HEALTHY", 1, 0), "bad": ("DEGRADED", 1, 1), "off": ("DISABLED", 0, 0),
        "new": ("NO_DATA", 0, 0),
    }


def test_latest_run_agrees_with_the_rolling_window(spark, folder):
    runs = t.runs(spark, folder)
    latest = health.latest_runs(runs).select("run_id", "failed_runs_last_24")
    rolling = health.failed_runs(runs).select("run_id", "failed_runs_last_24")
    assert latest.count() == 15
    assert latest.exceptAll(rolling).isEmpty()


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_blocks_do_not_change_the_rolling_count(rows, block):
    """Brute force over uneven gaps: many runs in some blocks, few or one in others."""
    history, at = [], AT
    for i in range(400):
        at += timedelta(minutes=[1, 7, 600, 3000][(i * i) % 4 if i % 40 < 30 else 0])
        source = "hot" if i % 5 else "cold"
        history.append((source, f"{i:04}", at, "FAILED" if i % 3 == 0 else "SUCCESS"))
    df = rows(
        "tenant_id STRING, source_id STRING, run_id STRING, completed_at TIMESTAMP, "
        "status STRING",
        *[("t", *h) for h in history],
    )
    got = {r.run_id: r.failed_runs_last_24 for r in health.failed_runs(df, block).collect()}
    expected = {}
    for name in ("hot", "cold"):
        own = [h for h in history if h[0] == name]
        for i, h in enumerate(own):
            expected[h[1]] = sum(x[3] == "FAILED" for x in own[max(0, i - 23) : i + 1])
    assert got == expected


def test_quota_day_follows_the_reset_zone(rows):
    usage = rows(
        "tenant_id STRING, source_id STRING, bucket STRING, used_at TIMESTAMP, units BIGINT",
        ("t", "s", "search", datetime(2024, 7, 2, 6, 59), 1),
        ("t", "s", "search", datetime(2024, 7, 2, 7, 1), 90),
        ("t", "s", "search", datetime(2024, 7, 2, 8, 0), 50),
        ("t", "s", "core", datetime(2024, 7, 2, 8, 0), 1),
    )
    got = {
        (r.bucket, str(r.quota_day)): (r.used, r.remaining)
        for r in health.quota_headroom(usage).collect()
    }
    assert got == {
        ("search", "2024-07-01"): (1, 94),
        ("search", "2024-07-02"): (140, 0),
        ("core", "2024-07-02"): (1, 9499),
    }


def test_brand_risk_uses_each_tenants_own_latest_day(rows):
    df = rows(
        "tenant_id STRING, metric_date DATE, brand STRING, mentions BIGINT, "
        "negative_share DOUBLE, high_risk_mentions BIGINT",
        ("a", AT.date(), "B", 5, 0.5, 30),
        ("a", (AT - 24 * HOUR).date(), "B", 5, 1.0, 0),
        ("b", (AT - 48 * HOUR).date(), "B", 5, 0.0, 0),
    )
    got = {r.tenant_id: (r.score, r.severity) for r in signals.brand_risk_signals(df).collect()}
    assert got == {"a": (70.0, "critical"), "b": (0.0, "info")}


def test_unmapped_signals_stay(spark, folder, rows):
    feed = rows(
        "tenant_id STRING, signal_type STRING, signal_key STRING, signal_ts TIMESTAMP, "
        "score DOUBLE, severity STRING, summary STRING, evidence_count BIGINT, "
        "source_table STRING",
        ("t0", "trend", "Battery_Issue", AT, 90.0, "critical", "s", 10, "x"),
        ("t0", "brand_risk", "nothing", AT, 90.0, "critical", "s", 10, "x"),
    )
    got = {
        r.signal_key: r
        for r in signals.opportunities(
            feed, t.signal_map(spark), t.products(spark, folder), AT
        ).collect()
    }
    mapped, unmapped = got["Battery_Issue"], got["nothing"]
    assert (mapped.status, mapped.product_id, mapped.product_fit) == ("OPEN", "3", 1.0)
    assert (unmapped.status, unmapped.product_fit) == ("NEEDS_MAPPING", 0.2)
    assert unmapped.preferred_channel == "analyst-review"
    assert unmapped.expires_at - AT == timedelta(days=2)
    assert mapped.expires_at - AT == timedelta(days=7)


def test_attestation_detects_tampering(rows):
    df = rows(
        "signal_score DOUBLE, evidence_count BIGINT, product_fit DOUBLE, commercial_fit DOUBLE",
        (80.0, 20, 0.9, 0.8), (None, 1, 0.5, 0.5),
    )
    scored = signals.attest_scores(
        df.withColumns({"priority_score": F.lit(0.0), "confidence_score": F.lit(0.0)})
    )
    honest = scored.withColumns(
        {"priority_score": F.col("expected_priority"),
         "confidence_score": F.col("expected_confidence")}
    ).select(*df.columns, "priority_score", "confidence_score")
    assert [r.attested for r in scored.collect()] == [False, False]
    assert [r.attested for r in signals.attest_scores(honest).collect()] == [True, False]


def test_public_status_hides_paths_and_incomplete_runs(spark, folder):
    runs = t.runs(spark, folder).limit(50)
    status = health.public_status(runs, t.RUNS_AS_OF)
    assert not {"event_path", "tenant_id"} & set(status.columns)
    assert health.public_status(runs.withColumn("runtime", F.lit("")), t.RUNS_AS_OF).isEmpty()
