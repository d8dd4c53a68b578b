"""Runs over newly ingested rows: equal to one run over all, and confined to touched days."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import envelope, health, incremental, metrics, posts
from tidemark.operators.incremental import DAY
from tidemark.plans import collect, refresh
from tidemark.plans import incremental as plan
from tidemark.plans.warehouse import Warehouse
from tidemark.queries import tables as t
from tidemark.sources import providers
from tidemark.streaming.ingest import DAY as INGESTED

AS_OF = datetime(2024, 1, 31)
COMPARED = (
    "bronze_dead_letter_events", "bronze_social_posts", "silver_social_posts", "gold_topic_hourly",
    "gold_trend_hourly", "gold_challenge_participation", "gold_challenge_hourly", "gold_brand_daily",
    "gold_trend_snapshot", "gold_challenge_snapshot", "gold_executive_kpis", "gold_source_health",
    "gold_signal_feed", "gold_delivery_latency", "gold_delivery_keys", "gold_kpi_hours",
)


def content(df):
    rows = df.select([F.to_json(c).alias(c) if "map<" in kind else c for c, kind in df.dtypes])
    rounded = [
        tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r)
        for r in rows.select(sorted(rows.columns)).collect()
    ]
    return sorted(rounded, key=repr)


def state_of(w):
    return {name: content(w.table(name).drop("evaluated_at", "refreshed_at")) for name in COMPARED}


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Four deliveries: old days, corrections of them, a late day, the newest days."""
    events = t.deliveries(spark, folder, full_payload=True).drop("ingested_at")
    at = F.col("occurred_at")
    events = events.filter(F.dayofmonth(at).isin(8, 9, 10, 11, 20, 21))  # few partitions, quick runs
    old = events.filter((at < "2024-01-20") & (F.to_date(at) != F.lit("2024-01-10").cast("date")))
    number = F.col("source_object_id").cast("int")
    changed = old.filter(~F.col("event_id").startswith("r") & (number % 40).isin(1, 2, 3)).withColumns(
        {
            "event_id": F.concat(F.lit("c"), "event_id"),
            "collected_at": F.col("collected_at") + F.expr("INTERVAL 5 HOURS"),
            # moved to another day, no longer a post, and no longer plausible
            "payload": F.when(number % 40 == 1, F.regexp_replace(
                "payload", r'"created_at":"2024-01-\d\d', '"created_at":"2024-01-03'
            )).when(number % 40 == 2, F.when(F.col("payload").isNotNull(), F.lit("{}"))).otherwise(
                F.regexp_replace("payload", r'"views":\d+', '"views":-1')
            ),
        }
    )
    late = events.filter(F.to_date(at) == F.lit("2024-01-10").cast("date"))
    rest = events.filter(at >= "2024-01-20")
    root, out = tmp_path_factory.mktemp("steps"), []
    for n, (rows, stamp) in enumerate(
        ((old, "2024-01-20 06:00:00"), (changed, "2024-01-21 07:00:00"), (late, "2024-01-21 09:00:00"),
         (rest, "2024-01-31 06:00:00"))
    ):
        rows = rows.withColumn("ingested_at", F.lit(stamp).cast("timestamp"))
        rows.withColumn(INGESTED, F.to_date("ingested_at")).write.parquet(f"{root}/{n}")
        out.append(spark.read.parquet(f"{root}/{n}"))
    return out


def deliver(w, rows):
    rows.write.mode("append").partitionBy(INGESTED).parquet(w.path("bronze_social_events"))


@pytest.fixture
def warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), f"inc_{uuid.uuid4().hex}")
    w.replace("control_event_contracts", t.contracts(spark))
    w.replace("control_source_registry", t.registry(spark))
    return w


@pytest.fixture(scope="module")
def whole(spark, steps, tmp_path_factory):
    """One run over all deliveries."""
    w = Warehouse(spark, str(tmp_path_factory.mktemp("whole")), f"whole_{uuid.uuid4().hex}")
    w.replace("control_event_contracts", t.contracts(spark))
    w.replace("control_source_registry", t.registry(spark))
    for rows in steps:
        deliver(w, rows)
    refresh.refresh_facts(w, AS_OF)
    return w


@pytest.fixture(scope="module")
def expected(whole):
    return state_of(whole)


def test_one_run_equals_the_operators_over_all_rows(spark, whole):
    events = whole.table("bronze_social_events")
    contracts, registry = t.contracts(spark), t.registry(spark)
    accepted = posts.dedup_deliveries(envelope.accept_events(events, contracts, registry))
    silver = posts.silver_posts(envelope.parse_post_payload(accepted)).cache()
    pairs = {
        "silver_social_posts": silver,
        "gold_brand_daily": metrics.brand_daily(silver),
        "gold_trend_hourly": metrics.trend_hourly(metrics.topic_hourly(silver)),
        "gold_challenge_hourly": metrics.challenge_hourly(silver),
        "gold_trend_snapshot": metrics.trend_snapshot(metrics.trend_hourly(metrics.topic_hourly(silver))),
        "gold_challenge_snapshot": metrics.challenge_snapshot(metrics.challenge_hourly(silver)),
        "gold_executive_kpis": metrics.executive_kpis(silver),
        "gold_source_health": health.source_health(
            events, envelope.dead_letter(events, contracts, registry), registry, AS_OF
        ),
    }
    for name, df in pairs.items():
        kept = [c for c in df.columns if c != "evaluated_at"]
        assert content(whole.table(name).select(kept)) == content(df.select(kept)), name
    silver.unpersist()


def files(w, name, where):
    return sorted(w.table(name).filter(where).inputFiles())


def test_four_runs_equal_one(warehouse, steps, expected):
    days, other, later = [], f"{DAY} <> '2024-01-10'", f"{DAY} > '2024-01-10'"
    daily = ("silver_social_posts", "gold_topic_hourly", "gold_brand_daily", "gold_kpi_hours")
    for n, rows in enumerate(steps):
        if n == 2:
            before = {name: files(warehouse, name, other) for name in daily}
            scores = [files(warehouse, "gold_trend_hourly", x) for x in (f"{DAY} < '2024-01-10'", later)]
        deliver(warehouse, rows)
        days.append(refresh.refresh_facts(warehouse, AS_OF))
        if n == 2:  # a late day rewrites its own partitions, and the scores from it on
            assert {name: files(warehouse, name, other) for name in daily} == before
            assert files(warehouse, "gold_trend_hourly", f"{DAY} < '2024-01-10'") == scores[0]
            assert files(warehouse, "gold_trend_hourly", later) != scores[1]
            assert not warehouse.table("gold_brand_daily").filter(f"{DAY} = '2024-01-10'").isEmpty()
    assert state_of(warehouse) == expected
    assert days[0][0] < "2024-01-20" and "2024-01-10" not in days[0]
    assert "2024-01-03" in days[1] and days[2] == ["2024-01-10"] and days[3][0] >= "2024-01-20"
    assert refresh.refresh_facts(warehouse, AS_OF) == [] and state_of(warehouse) == expected


def test_a_lost_run_is_repeated_and_changed_sources_rebuild(warehouse, steps, expected, spark, monkeypatch):
    deliver(warehouse, steps[0])
    plan.refresh_increment(warehouse)
    deliver(warehouse, steps[1])

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(plan, "_refresh_windows", fail)
        with pytest.raises(RuntimeError, match="lost"):
            plan.refresh_increment(warehouse)
    assert plan.progress(warehouse).days
    deliver(warehouse, steps[2])
    deliver(warehouse, steps[3])
    refresh.refresh_facts(warehouse, AS_OF)
    assert state_of(warehouse) == expected and not plan.progress(warehouse).days
    before = warehouse.table("silver_social_posts").count()
    warehouse.replace("control_source_registry", t.registry(spark).withColumn("enabled", F.lit(True)))
    assert len(plan.refresh_increment(warehouse)) > 5
    assert warehouse.table("silver_social_posts").count() > before
    assert plan.refresh_increment(warehouse) == []


def test_a_run_without_an_accepted_post_makes_empty_tables(warehouse, steps):
    deliver(warehouse, steps[0].filter("schema_version = '0.9'"))
    assert refresh.refresh_facts(warehouse, AS_OF) == []
    for name in ("silver_social_posts", "gold_trend_snapshot", "gold_brand_daily", "gold_executive_kpis"):
        assert warehouse.table(name).isEmpty()
    assert not warehouse.table("bronze_dead_letter_events").isEmpty()


def test_media_without_an_account_are_kept_aside(warehouse, spark, folder, tmp_path):
    pages = t.instagram_pages(spark, folder)
    accounts = t.instagram_account_pages(spark)
    aside = collect.collect_media(warehouse, pages, accounts.filter("tenant_id <> 't1'"), f"{tmp_path}/landing")
    held = aside.count()
    assert held and {r.tenant_id for r in aside.select("tenant_id").distinct().collect()} == {"t1"}
    landed = spark.read.json(f"{tmp_path}/landing").count()
    everything = providers.map_instagram_media(pages, providers.linked_accounts(accounts)).count()
    assert landed + held == everything
    again = collect.collect_media(warehouse, pages, accounts.filter("tenant_id <> 't1'"), f"{tmp_path}/two")
    assert again.count() == held
    linked = collect.collect_media(warehouse, pages, accounts, f"{tmp_path}/three")
    assert linked.isEmpty() and spark.read.json(f"{tmp_path}/three").count() == everything


def test_state_equals_history_at_every_cut(spark, rows):
    hours = spark.range(60).select(
        F.lit("t").alias("tenant_id"),
        F.when(F.col("id") % 7 == 3, "rare").otherwise("often").alias("topic"),
        F.timestamp_seconds(F.col("id") * 7200 + F.lit(1_704_067_200)).alias("hour_ts"),
        (F.col("id") * 37 % 11 + 1).alias("post_count"),
        (F.col("id") * 53 % 17).alias("engagements"),
        F.lit(3).cast("bigint").alias("creator_count"),
        F.lit(2).cast("bigint").alias("platform_count"),
        F.lit(0.5).alias("positive_share"),
    ).cache()
    truth = content(metrics.trend_hourly(hours))
    for cut in (0, 1, 5, 30, 59, 60):
        at = F.timestamp_seconds(F.lit(cut * 7200 + 1_704_067_200))
        early, late = hours.filter(F.col("hour_ts") < at), hours.filter(F.col("hour_ts") >= at)
        first = metrics.trend_hourly(early)
        state = incremental.window_state(first, "topic", metrics.TREND_MEASURES, metrics.BASELINE_ROWS)
        second = metrics.trend_hourly(late, state=state)
        assert content(first.unionByName(second)) == truth
        rolled = incremental.window_state(
            second, "topic", metrics.TREND_MEASURES, metrics.BASELINE_ROWS, state
        )
        direct = incremental.window_state(
            metrics.trend_hourly(hours), "topic", metrics.TREND_MEASURES, metrics.BASELINE_ROWS
        )
        assert content(rolled) == content(direct)
    hours.unpersist()


def test_key_ledger_counts_each_key_once(rows):
    ddl = "tenant_id STRING, source_id STRING, idempotency_key STRING, day STRING"
    ledger = incremental.new_keys(rows(ddl, ("t", "s", "a", "1"), ("t", "s", None, "1"), (None, "s", "a", "1")), None, "day")
    more = incremental.new_keys(
        rows(ddl, ("t", "s", "a", "2"), ("t", "s", "b", "3"), ("t", "s", "b", "2"), (None, "s", "a", "2")), ledger, "day"
    )
    assert sorted(tuple(r) for r in more.collect()) == [("t", "s", "b", "2")]


def test_bitmaps_count_across_runs(spark, rows):
    ddl = "tenant_id STRING, dimension STRING, value STRING"
    first = incremental.numbered_ids(rows(ddl, ("t", "c", "a"), ("t", "c", "b"), ("u", "c", "a")), 0)
    start = incremental.next_id(first.agg(F.max("id")).first()[0])
    assert start >= 1 << 33 and incremental.next_id(None) == 0
    known = first.unionByName(incremental.numbered_ids(rows(ddl, ("t", "c", "z")), start))
    seen = rows(ddl + ", hour_ts INT", ("t", "c", "a", 1), ("t", "c", "a", 2), ("t", "c", "z", 2), ("u", "c", "a", 1))
    maps = incremental.hour_bitmaps(seen, known, "hour_ts")
    got = incremental.distinct_counts(maps, {"c": "creators", "d": "none"}).collect()
    assert sorted(tuple(r) for r in got) == [("t", 2, 0), ("u", 1, 0)]


def test_payloads_are_made_by_all_tasks(spark, tmp_path):
    made = spark.range(3000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 50 AS user_id",
        "'signup' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"k\": 1}' AS props",
    )
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = t.deliveries(spark, str(tmp_path), full_payload=True).filter("event_id NOT LIKE 'r%'")
        dealt = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == 3000
