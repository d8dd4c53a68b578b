"""Facts brought up to date from newly ingested rows alone.

A run takes the bronze rows ingested since the last one and finds the keys they touch; a narrow scan of
key columns finds the days in which those posts lie now. Only these days of the post tables and of the
facts are rewritten (dynamic partition overwrite); window scores continue from carried state, on the
days from the first touched one on; delivery counts are added up by day of ingestion.

Whatever the run order, lateness or repetition, the tables equal those of a single run over all rows.
``control_refresh_progress`` holds how far ingestion was taken in, and, while a run is under way, the
days it has begun to rewrite: a run that was lost is repeated with them and ends with the same tables.
When the contracts or sources change, acceptance of old rows changes with them and everything is built anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import envelope, health, incremental, metrics, posts
from tidemark.operators.incremental import DAY, day_of
from tidemark.plans.warehouse import Warehouse
from tidemark.sources.files import inline_values
from tidemark.sources.tables import values_of
from tidemark.streaming.ingest import DAY as INGESTED

PROGRESS = "control_refresh_progress"
_PROGRESS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("through", "upto", "control")]
    + [T.StructField("days", T.ArrayType(T.StringType()))]
)
POST = ["tenant_id", "platform", "post_id"]
DELIVERY = ["tenant_id", "idempotency_key"]
#: When the delivery was collected; the payload has a time of its own.
DELIVERED = "delivered_at"

#: Tables of a run, all partitioned by day, that a rebuild begins without.
BUILT = (
    "bronze_dead_letter_events",
    "bronze_accepted_posts",
    "bronze_accepted_trends",
    "silver_social_posts",
    "gold_topic_hourly",
    "gold_trend_hourly",
    "gold_trend_state",
    "gold_challenge_participation",
    "gold_challenge_hourly",
    "gold_challenge_state",
    "gold_brand_daily",
    "gold_delivery_latency",
    "gold_delivery_keys",
    "gold_kpi_hours",
    "gold_kpi_ids",
    "gold_kpi_bitmaps",
)
#: Snapshots of window state that stay; older days are rebuilt from the hourly facts when they are touched.
STATE_DAYS = 35


@dataclass
class Progress:
    """Ingestion taken in so far and by the run under way, in microseconds; its days."""

    through: int | None = None
    upto: int | None = None
    control: int | None = None
    days: list[str] = field(default_factory=list)


def progress(w: Warehouse) -> Progress:
    if not w.exists(PROGRESS):
        return Progress()
    row = w.table(PROGRESS).first()
    return Progress(row.through, row.upto, row.control, list(row.days or ()))


def _note(w: Warehouse, p: Progress) -> None:
    w.replace(PROGRESS, inline_values(w.spark, [(p.through, p.upto, p.control, p.days)], _PROGRESS))


def _newest_first(collected: str) -> list:
    return [F.desc(c) for c in (collected, "ingested_at", "event_id")]


def _control_print(w: Warehouse) -> int:
    """A number that changes with the active contracts and enabled sources."""
    contracts = w.durable("control_event_contracts").filter("active")
    sources = w.durable("control_source_registry").filter("enabled")
    keys = contracts.select(F.xxhash64(F.lit("contract"), "schema_version", "event_type").alias("h"))
    keys = keys.unionByName(sources.select(F.xxhash64(F.lit("source"), "tenant_id", "source_id").alias("h")))
    return keys.distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0))).first()[0]


def _stored(w: Warehouse, name: str, days: Sequence[str]) -> DataFrame | None:
    return w.table(name).filter(F.col(DAY).isin(list(days))) if w.exists(name) else None


def refresh_increment(w: Warehouse) -> list[str]:
    """Take in everything ingested since the last run; the days of posts that were rewritten."""
    state, control = progress(w), _control_print(w)
    if state.control is not None and state.control != control:
        w.drop(*BUILT, PROGRESS)
        state = Progress()
    events = w.table("bronze_social_events")
    new = events
    if state.through is not None:
        since = F.timestamp_micros(F.lit(state.through))
        # A day more, should an earlier session have named its days in another zone.
        recent = F.col(INGESTED) >= F.date_sub(F.to_date(since), 1)
        new = events.filter(recent & (F.col("ingested_at") > since))
    upto, first = new.agg(F.unix_micros(F.max("ingested_at")), F.min(INGESTED)).first()
    if upto is None and not state.days:
        return []
    under_way = Progress(state.through, upto or state.through, control, state.days)
    new = new.filter(F.col("ingested_at") <= F.timestamp_micros(F.lit(under_way.upto)))
    _refresh_deliveries(w, events, first)
    days = _refresh_posts(w, new, under_way)
    _refresh_trends(w, new)
    _refresh_facts(w, days)
    _note(w, Progress(under_way.upto, under_way.upto, control, []))
    return days


def _accepted(w: Warehouse, new: DataFrame, types: Sequence[str]) -> DataFrame:
    return envelope.accept_events(
        new, w.durable("control_event_contracts"), w.durable("control_source_registry"), types
    )


def _refresh_deliveries(w: Warehouse, events: DataFrame, first) -> None:
    """Quarantine, latency counts and key ledger from the first day of ingestion with new rows on.

    Days of ingestion only grow at their end, so these are one or two.
    """
    if first is None:
        return
    own = events.filter(F.col(INGESTED) >= F.lit(first))
    own = own.withColumn(DAY, F.date_format(INGESTED, "yyyy-MM-dd"))
    days = values_of(own, DAY)
    rejected = envelope.dead_letter(
        own, w.durable("control_event_contracts"), w.durable("control_source_registry")
    )
    w.overwrite("bronze_dead_letter_events", rejected.drop(INGESTED), DAY, days)
    histogram = incremental.latency_histogram(own, DAY)
    w.overwrite("gold_delivery_latency", histogram, DAY, days)
    ledger = None
    if w.exists("gold_delivery_keys"):
        ledger = w.table("gold_delivery_keys").filter(~F.col(DAY).isin(days))
    w.overwrite("gold_delivery_keys", incremental.new_keys(own, ledger, DAY), DAY, days)


def _refresh_posts(w: Warehouse, new: DataFrame, under_way: Progress) -> list[str]:
    """Accepted deliveries and canonical posts; the days of posts that changed.

    The latest delivery of a key counts even where its payload is no post, so such rows are kept among the
    accepted ones. What the run is about to touch is written down before anything is rewritten.
    """
    incoming = posts.dedup_deliveries(_accepted(w, new, envelope.POST_EVENT_TYPES))
    incoming = envelope.flatten_post_payload(incoming, F.col("collected_at").alias(DELIVERED))
    incoming = incoming.withColumn(DAY, day_of("created_at"))
    incoming = w.stage("increment_posts", incoming)
    keys = incoming.select(*DELIVERY)
    identities = incoming.select(*POST)
    if w.exists("bronze_accepted_posts"):
        before = incremental.touched(w.table("bronze_accepted_posts"), keys, *POST, DAY)
        identities = identities.unionByName(before.select(*POST))
    if under_way.days and w.exists("increment_identities"):  # of the run that was lost
        identities = identities.unionByName(w.table("increment_identities"))
    identities = w.replace("increment_identities", identities.filter(_complete(POST)).distinct())
    # Where touched deliveries and posts lie now; older versions of a post may win in their own days.
    places = [incoming.select(DAY)]
    for name, touched in (
        ("bronze_accepted_posts", keys),
        ("bronze_accepted_posts", identities),
        ("silver_social_posts", identities),
    ):
        if w.exists(name):
            places.append(incremental.touched(w.table(name), touched, DAY).select(DAY))
    days = set(under_way.days) | set(values_of(reduce(DataFrame.unionByName, places), DAY))
    days = sorted(days)
    if not days and w.exists("silver_social_posts"):
        return []
    _note(w, Progress(under_way.through, under_way.upto, under_way.control, days))

    held = _stored(w, "bronze_accepted_posts", days)
    accepted = incoming if held is None else incremental.upserted(
        held, incoming.select(*held.columns), DELIVERY, _newest_first(DELIVERED)
    )
    accepted = w.overwrite("bronze_accepted_posts", accepted, DAY, days)

    candidates = accepted.filter(F.col(DAY).isin(days) & F.col("post_id").isNotNull())
    candidates = candidates.join(identities, POST, "left_semi").drop(DAY, DELIVERED)
    winners = posts.silver_posts(candidates).withColumn(DAY, day_of("created_at"))
    held = _stored(w, "silver_social_posts", days)
    if held is not None:
        winners = held.join(identities, POST, "left_anti").unionByName(winners.select(*held.columns))
    w.overwrite("silver_social_posts", winners, DAY, days)
    return days


def _complete(keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _refresh_trends(w: Warehouse, new: DataFrame) -> None:
    """Accepted trend observations, by day of collection."""
    incoming = posts.dedup_deliveries(_accepted(w, new, envelope.TREND_EVENT_TYPES))
    incoming = envelope.flatten_trend_payload(incoming).withColumn(DAY, day_of("collected_at"))
    incoming = w.stage("increment_trends", incoming)
    days = set(values_of(incoming, DAY))
    if w.exists("bronze_accepted_trends"):
        stored = w.table("bronze_accepted_trends")
        days |= set(values_of(incremental.touched(stored, incoming.select(*DELIVERY), DAY), DAY))
    elif not days:
        w.overwrite("bronze_accepted_trends", incoming, DAY, [])
    if not days:
        return
    held = _stored(w, "bronze_accepted_trends", sorted(days))
    rows = incoming if held is None else incremental.upserted(
        held, incoming.select(*held.columns), DELIVERY, _newest_first("collected_at")
    )
    w.overwrite("bronze_accepted_trends", rows, DAY, sorted(days))


def _refresh_facts(w: Warehouse, days: Sequence[str]) -> None:
    """Facts of the touched days, and window scores from the first of them on."""
    if not days and w.exists("gold_trend_state"):
        return
    first = days[0] if days else "none"
    silver = w.table("silver_social_posts").filter(F.col(DAY).isin(list(days)))
    for name, facts, at in (
        ("gold_topic_hourly", metrics.topic_hourly(silver), "hour_ts"),
        ("gold_challenge_participation", metrics.challenge_participation(silver), "hour_ts"),
        ("gold_brand_daily", metrics.brand_daily(silver), "metric_date"),
    ):
        w.overwrite(name, facts.withColumn(DAY, day_of(at)), DAY, days)
    refresh_kpis(w, silver, days)
    _refresh_windows(
        w, first, "topic", "gold_topic_hourly", "gold_trend_hourly", "gold_trend_state",
        metrics.TREND_MEASURES, metrics.BASELINE_ROWS,
        lambda rows, state: metrics.trend_hourly(rows, state=state),
    )
    _refresh_windows(
        w, first, "challenge_name", "gold_challenge_participation", "gold_challenge_hourly",
        "gold_challenge_state", metrics.CHALLENGE_MEASURES, metrics.CHALLENGE_ROWS,
        metrics.challenge_scores,
    )


def _refresh_windows(w, first, entity, source, target, states, measures, keep, score) -> None:
    """Scores of all hours from day ``first`` on, continued from the state before that day.

    The newest snapshot before the day serves if no later hour lies before the day; else the state
    is taken from the hourly facts, never from posts.
    """
    hourly, known = w.table(source), w.parts(source)
    earlier = [d for d in known if d < first]
    state = None
    if earlier:
        if earlier[-1] in w.parts(states):
            state = w.table(states).filter(F.col(DAY) == earlier[-1]).drop(DAY)
        else:
            scored = w.table(target).filter(F.col(DAY) < first).drop(DAY)
            state = incremental.window_state(scored, entity, measures, keep)
    rows = hourly.filter(F.col(DAY) >= first).drop(DAY)
    later = {d for d in (*known, *w.parts(target)) if d >= first}
    w.overwrite(target, score(rows, state).withColumn(DAY, day_of("hour_ts")), DAY, sorted(later))
    held = w.parts(states)
    stale = {d for d in held if d >= first} | set(held[: max(0, len(held) - STATE_DAYS)])
    newest = known[-1] if known else "none"
    done = w.table(target).filter(F.col(DAY) >= first).drop(DAY)
    made = incremental.window_state(done, entity, measures, keep, state).withColumn(DAY, F.lit(newest))
    w.overwrite(states, made, DAY, sorted(stale | {newest}))


def refresh_kpis(w: Warehouse, silver: DataFrame, days: Sequence[str]) -> None:
    """Hour sums of some days' posts, ids of new creators and topics, and the hours' bitmaps."""
    hours = metrics.kpi_hours(silver).withColumn(DAY, day_of("hour_ts"))
    w.overwrite("gold_kpi_hours", hours, DAY, days)
    found = _members(silver)
    values = found.select("tenant_id", "dimension", "value").distinct()
    first = 0
    if w.exists("gold_kpi_ids"):
        known = w.table("gold_kpi_ids")
        first = incremental.next_id(known.agg(F.max("id")).first()[0])
        probe = known.join(values, ["tenant_id", "dimension", "value"], "left_semi")
        values = values.join(probe.select(*values.columns), values.columns, "left_anti")
    # Numbered as stored, so that a repeated task gives the same ids.
    values = w.stage("increment_values", values)
    fresh = incremental.numbered_ids(values, first).withColumn("run", F.lit(f"{first >> 33:012d}"))
    w.overwrite("gold_kpi_ids", fresh, "run", [])
    bitmaps = incremental.hour_bitmaps(found, w.table("gold_kpi_ids"), "hour_ts")
    w.overwrite("gold_kpi_bitmaps", bitmaps.withColumn(DAY, day_of("hour_ts")), DAY, days)


def _members(silver: DataFrame) -> DataFrame:
    return incremental.members(silver, metrics.KPI_DIMENSIONS)


def executive_kpis(w: Warehouse) -> DataFrame:
    """Trailing measures per tenant from hours and bitmaps; of posts, only each window's cut hour is read."""
    hours, bitmaps = w.table("gold_kpi_hours").drop(DAY), w.table("gold_kpi_bitmaps").drop(DAY)
    windows = metrics.kpi_windows(hours)
    cut = windows.withColumn(DAY, day_of("edge_ts"))
    # One value that reaches the scan, which then lists the last days only.
    silver = w.table("silver_social_posts").filter(F.col(DAY) >= cut.agg(F.min(DAY)).scalar())
    edge = silver.join(cut, ["tenant_id", DAY])
    inside = (F.date_trunc("hour", "created_at") == F.col("edge_ts")) & (F.col("created_at") >= F.col("start_at"))
    edge = edge.filter(inside).select("tenant_id", "created_at", *metrics.KPI_COLUMNS)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.join(windows, "tenant_id").filter(F.col("hour_ts") > F.col("edge_ts")).select(*rows.columns)

    edge_maps = incremental.hour_bitmaps(_members(edge), w.table("gold_kpi_ids"), "hour_ts")
    counts = incremental.distinct_counts(
        whole(bitmaps).unionByName(edge_maps.select(*bitmaps.columns)), metrics.KPI_COUNTS
    )
    return metrics.kpis_from_hours(whole(hours).unionByName(metrics.kpi_hours(edge)), counts)


def source_health(w: Warehouse, as_of) -> DataFrame:
    """Health of every registered source from the counts kept by day of ingestion."""
    delivery = health.merged_delivery(w.table("gold_delivery_latency"), w.table("gold_delivery_keys"))
    rejections = health.source_rejections(w.table("bronze_dead_letter_events"))
    return health.health_of(delivery, rejections, w.durable("control_source_registry"), as_of)
