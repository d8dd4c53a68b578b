"""Serving reads, row counts, marts, projections and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators import metrics, serving
from tidemark.operators.envelope import dead_letter, envelope_to_record
from tidemark.queries import decisions
from tidemark.queries import tables as t
from tidemark.queries.registry import query
from tidemark.sources import files, tables
from tidemark.streaming import ingest

_PARTS = """(SELECT 't' || (p_partkey % 3) AS tenant_id, 'opp-' || p_partkey AS opportunity_id,
  (p_size * 2)::DOUBLE AS opportunity_score,
  CASE WHEN p_size % 2 = 0 THEN 'OPEN' ELSE 'WATCH' END AS status FROM part)"""
_LISTED = f"{_PARTS} WHERE tenant_id = 't0' AND status = 'OPEN' AND opportunity_score >= 20"


def _page(spark, folder):
    return serving.list_opportunities(
        decisions.part_opportunities(spark, folder), "t0", status="open", min_score=20, limit=25
    )


@query(
    "list_opportunities",
    f"""SELECT opportunity_id, opportunity_score, status FROM {_LISTED}
    ORDER BY opportunity_score DESC, opportunity_id DESC LIMIT 25""",
)
def list_opportunities(spark, folder):
    return _page(spark, folder).items.select("opportunity_id", "opportunity_score", "status")


@query(
    "list_opportunities_summary",
    f"""SELECT 't0' AS tenant_id, least(count(*), 25) AS returned, count(*) AS available,
      count(*) > 25 AS next_page FROM {_LISTED}""",
)
def list_opportunities_summary(spark, folder):
    return _page(spark, folder).summary


@query(
    "list_metrics",
    """SELECT 'views' AS metric_name, source_id, created_at AS observed_at,
      views::DOUBLE AS value FROM posts_v WHERE tenant_id = 't0' AND source_id = 'src-reddit'
    ORDER BY created_at DESC LIMIT 40""",
)
def list_metrics(spark, folder):
    points = t.posts(spark, folder).select(
        "tenant_id",
        F.lit("views").alias("metric_name"),
        "source_id",
        F.col("created_at").alias("observed_at"),
        F.col("views").cast("double").alias("value"),
    )
    page = serving.list_metrics(
        points, "t0", metric_name="views", source_id="src-reddit", limit=40
    )
    return t.plain(page.items.drop("tenant_id"))


def _statuses(spark, folder):
    return t.runs(spark, folder).select(
        "tenant_id",
        "source_id",
        F.when(F.col("status") == "SUCCESS", F.lit("healthy"))
        .otherwise(F.lit("failing"))
        .alias("status"),
        F.col("completed_at").alias("last_success_at"),
    )


@query(
    "source_status",
    """SELECT 't0' AS tenant_id, count(*) AS sources, bool_and(status = 'SUCCESS') AS healthy
    FROM runs_v WHERE tenant_id = 't0'""",
)
def source_status(spark, folder):
    return serving.source_statuses(_statuses(spark, folder), "t0").summary


@query(
    "source_status_items",
    """SELECT 't0' AS tenant_id, source_id, CASE WHEN status = 'SUCCESS' THEN 'healthy' ELSE 'failing' END
      AS status, completed_at AS last_success_at
    FROM runs_v WHERE tenant_id = 't0' AND source_id = '2-HIGH'""",
)
def source_status_items(spark, folder):
    """The status rows of one source behind the verdict."""
    return t.plain(serving.source_statuses(_statuses(spark, folder), "t0", "2-HIGH").items)


@query(
    "tenant_scope",
    "SELECT post_id, platform FROM posts_v WHERE tenant_id = 't1'",
)
def tenant_scope(spark, folder):
    scoped = serving.tenant_scope(t.posts(spark, folder), "t1", allowed={"t0", "t1"})
    return scoped.select("post_id", "platform")


def _evidence(spark, folder):
    """Evidence 0 to 9 of every tenant, from the customers; ids above six are missing."""
    return (
        t.load(spark, folder, "customer")
        .select(
            F.concat(F.lit("t"), F.col("c_custkey") % 3).alias("tenant_id"),
            (F.col("c_custkey") % 10).alias("_number"),
        )
        .filter("_number <= 6")
        .distinct()
        .select(
            "tenant_id",
            F.concat(F.lit("ev-"), "_number").alias("evidence_id"),
            F.lit("metric").alias("source_type"),
        )
    )


_WANTED = """(SELECT 't' || (p_partkey % 3) AS tenant_id, 'opp-' || p_partkey AS opportunity_id,
  unnest([p_partkey % 10, p_partkey % 4]) AS number FROM part WHERE p_partkey % 3 <> 2)"""


@query(
    "evidence_lookup",
    f"""SELECT tenant_id, opportunity_id, 'ev-' || number AS evidence_id,
      'metric' AS source_type FROM {_WANTED} WHERE number <= 6""",
)
def evidence_lookup(spark, folder):
    found, _ = serving.evidence_lookup(
        decisions.part_opportunities(spark, folder), _evidence(spark, folder)
    )
    return found.select("tenant_id", "opportunity_id", "evidence_id", "source_type")


@query(
    "evidence_missing",
    f"""SELECT tenant_id, opportunity_id, 'ev-' || number AS evidence_id
    FROM {_WANTED} WHERE number > 6""",
)
def evidence_missing(spark, folder):
    _, missing = serving.evidence_lookup(
        decisions.part_opportunities(spark, folder), _evidence(spark, folder)
    )
    return missing.select("tenant_id", "opportunity_id", "evidence_id")


# --- tables, marts, projections and streams ------------------------------------------


@query(
    "table_row_counts",
    """SELECT 'posts' AS table_name, count(*) AS row_count FROM posts_v
    UNION ALL SELECT 'deliveries', count(*) FROM deliveries_v
    UNION ALL SELECT 'runs', count(*) FROM runs_v
    UNION ALL SELECT 'experiments', count(*) FROM experiments_v""",
)
def table_row_counts(spark, folder):
    return files.table_row_counts(
        {
            "posts": t.posts(spark, folder),
            "deliveries": t.deliveries(spark, folder),
            "runs": t.runs(spark, folder),
            "experiments": t.experiments(spark, folder),
        }
    )


@query(
    "conform_columns",
    """SELECT run_id, tenant_id, source_id, completed_at, status, videos_discovered,
      NULL::BIGINT AS posts_discovered, NULL::BIGINT AS trends_discovered, 'kept' AS note FROM runs_v""",
)
def conform_columns(spark, folder):
    """Run records of an older shape, read as the declared one."""
    old = t.runs(spark, folder).drop("posts_discovered", "trends_discovered")
    rows = files.conform(old.withColumn("note", F.lit("kept")), schemas.CONNECTOR_RUN)
    return t.plain(
        rows.select(
            "run_id", "tenant_id", "source_id", "completed_at", "status", "videos_discovered",
            F.col("posts_discovered").cast("bigint"), F.col("trends_discovered").cast("bigint"), "note",
        )
    )


@query(
    "publish_replace",
    "SELECT tenant_id, topic, hour_ts, post_count FROM topic_hourly_v",
)
def publish_replace(spark, folder):
    """A mart published, then replaced by the full facts."""
    hourly = metrics.topic_hourly(t.silver(spark, folder)).select(
        "tenant_id", "topic", "hour_ts", "post_count"
    )
    mart = _managed(spark, "gold_topic_hourly")
    tables.publish_replace(hourly.filter("topic = 'lifestyle'"), mart)
    tables.publish_replace(hourly, mart)
    return t.plain(tables.read_mart(spark, mart))


@query(
    "publish_merge",
    """SELECT tenant_id, CAST(metric_date AS VARCHAR) AS metric_date, brand,
      mentions + CASE WHEN metric_date < DATE '2024-01-10' THEN 1000 ELSE 0 END AS mentions
    FROM brand_daily_v""",
)
def publish_merge(spark, folder):
    """A mart published through 19 January, then merged with corrected and new days."""
    brand = metrics.brand_daily(t.silver(spark, folder)).select(
        "tenant_id", "metric_date", "brand", "mentions"
    )
    mart = _managed(spark, "gold_brand_daily")
    keys = ("tenant_id", "metric_date", "brand")
    tables.publish(brand.filter("metric_date < '2024-01-20'"), mart, keys)
    later = brand.filter("metric_date < '2024-01-10' OR metric_date >= '2024-01-20'")
    bonus = F.when(F.col("metric_date") < "2024-01-10", F.lit(1000)).otherwise(F.lit(0))
    tables.publish(later.withColumn("mentions", F.col("mentions") + bonus), mart, keys)
    return t.plain(tables.read_mart(spark, mart).select(*brand.columns))


@query(
    "merge_by_part",
    """SELECT run_id, tenant_id, CASE WHEN tenant_id = 't1' THEN 'REVIEWED' ELSE status END AS status
    FROM runs_v""",
)
def merge_by_part(spark, folder):
    """Runs merged by their id: one tenant's runs are updated, another's are new."""
    runs = t.runs(spark, folder).select("run_id", "tenant_id", "status")
    table = _managed(spark, "runs")
    tables.publish(runs.filter("tenant_id <> 't2'"), table, ["run_id"])
    reviewed = F.when(F.col("tenant_id") == "t1", F.lit("REVIEWED")).otherwise(F.col("status"))
    tables.publish(runs.filter("tenant_id <> 't0'").withColumn("status", reviewed), table, ["run_id"])
    return tables.read_mart(spark, table).select(*runs.columns)


@query(
    "export_projection",
    """SELECT tenant_id, post_id, platform, views FROM posts_v""",
)
def export_projection(spark, folder):
    """A projection with a row per post, exported completely and read back."""
    rows = t.posts(spark, folder).select("tenant_id", "post_id", "platform", "views")
    paths = files.export_projections({"evidence": rows}, files.new_folder(spark, "projection"))
    return files.read_projection_snapshot(spark, paths["evidence"], rows.schema)


@query(
    "projection_page",
    """SELECT tenant_id, post_id, views, (SELECT count(*) FROM posts_v) AS available,
      (SELECT count(*) FROM posts_v) > 500 AS has_more
    FROM posts_v ORDER BY views DESC, post_id LIMIT 500""",
)
def projection_page(spark, folder):
    """The first ordered page of the same projection as one document."""
    rows = t.posts(spark, folder).select("tenant_id", "post_id", "views")
    order = [F.desc("views"), F.asc("post_id")]
    page = files.projection_document(rows, order, 500)
    shape = "items ARRAY<STRUCT<tenant_id: STRING, post_id: STRING, views: LONG>>"
    parsed = page.select(F.from_json("value", f"{shape}, available LONG, has_more BOOLEAN").alias("d"))
    return parsed.select(F.explode("d.items").alias("i"), "d.available", "d.has_more").select(
        "i.*", "available", "has_more"
    )


@query(
    "read_projection",
    """SELECT tenant_id, CAST(metric_date AS VARCHAR) AS metric_date, brand, mentions
    FROM brand_daily_v""",
)
def read_projection(spark, folder):
    """All brand days behind a serving view."""
    brand = metrics.brand_daily(t.silver(spark, folder))
    brand.select("tenant_id", "metric_date", "brand", "mentions").createOrReplaceTempView(
        "serving_metrics"
    )
    return t.plain(files.read_projection(spark, "metrics"))


@query(
    "land_ndjson",
    """SELECT post_id, platform, views, created_at FROM posts_v""",
)
def land_ndjson(spark, folder):
    """Post records landed as JSON lines in two batches and read as declared."""
    landing = files.new_folder(spark, "posts-landing")
    records = t.posts(spark, folder).select("post_id", "platform", "views", "created_at")
    for batch in ("platform = 'reddit'", "platform <> 'reddit'"):
        files.land_ndjson(records.filter(batch), landing)
    return t.plain(spark.read.schema(records.schema).json(landing))


@query(
    "stream_ingest",
    """SELECT event_id, tenant_id, source_id, event_type, occurred_at, collected_at,
      idempotency_key, replace(payload, ': ', ':') AS payload FROM deliveries_v""",
)
def stream_ingest(spark, folder):
    """All deliveries landed as JSON lines and drained into bronze; run twice, read once."""
    landing = files.new_folder(spark, "landing")
    checkpoint = files.new_folder(spark, "stream-checkpoint")
    bronze = files.new_folder(spark, "bronze")
    records = t.deliveries(spark, folder).drop("ingested_at")
    files.land_ndjson(envelope_to_record(records), landing)
    for _ in range(2):
        rows = ingest.read_event_stream(spark, landing, checkpoint, path=bronze)
    return t.plain(
        rows.select(
            "event_id", "tenant_id", "source_id", "event_type", "occurred_at", "collected_at",
            "idempotency_key", "payload",
        )
    )


@query(
    "stream_runs",
    """SELECT run_id, tenant_id, source_id, completed_at, status, search_calls_remaining
    FROM runs_v""",
)
def stream_runs(spark, folder):
    """All run records landed and drained in bounded micro-batches."""
    landing = files.new_folder(spark, "run-landing")
    files.land_ndjson(t.runs(spark, folder), landing)
    rows = ingest.read_run_metric_stream(
        spark,
        landing,
        files.new_folder(spark, "run-checkpoint"),
        path=files.new_folder(spark, "run-bronze"),
        max_files_per_trigger=1000,
    )
    return t.plain(
        rows.select(
            "run_id", "tenant_id", "source_id", "completed_at", "status",
            "search_calls_remaining",
        )
    )


@query(
    "stream_continuous",
    """SELECT run_id, tenant_id, source_id, completed_at, status, search_calls_remaining
    FROM runs_v""",
)
def stream_continuous(spark, folder):
    """Run records taken in by a query that goes on while more of them land."""
    landing, bronze = (files.new_folder(spark, n) for n in ("cont-landing", "cont-bronze"))
    runs = t.runs(spark, folder)
    files.land_ndjson(runs.filter("status = 'FAILED'"), landing)
    stream = ingest.read_json_stream(spark, landing, schemas.CONNECTOR_RUN)
    running = ingest.append_available(
        stream, files.new_folder(spark, "cont-checkpoint"), path=bronze, processing_time="100 milliseconds"
    )
    try:
        running.processAllAvailable()
        files.land_ndjson(runs.filter("status <> 'FAILED'"), landing)
        running.processAllAvailable()
    finally:
        running.stop()
    return t.plain(
        spark.read.parquet(bronze).select(
            "run_id", "tenant_id", "source_id", "completed_at", "status", "search_calls_remaining"
        )
    )


@query(
    "stream_batches",
    """SELECT run_id, tenant_id, source_id, completed_at, status, search_calls_remaining
    FROM runs_v""",
)
def stream_batches(spark, folder):
    """Run records in batches that replace themselves; all of them are replayed from a lost checkpoint."""
    landing, table = files.new_folder(spark, "batch-landing"), _managed(spark, "runs")
    files.land_ndjson(t.runs(spark, folder), landing)
    stream = ingest.read_json_stream(spark, landing, schemas.CONNECTOR_RUN, 1000)
    for _ in range(2):
        checkpoint = files.new_folder(spark, "batch-checkpoint")
        ingest.write_batches(stream, checkpoint, table).awaitTermination()
    return t.plain(
        spark.table(table).select(
            "run_id", "tenant_id", "source_id", "completed_at", "status", "search_calls_remaining"
        )
    )


@query(
    "stream_malformed",
    """SELECT 'missing_event_id,missing_idempotency_key,missing_tenant_id,missing_source_id,'
      || 'missing_payload,unsupported_contract,disabled_or_unregistered_source' AS rejection_reasons, count(*) AS lines FROM posts_v WHERE n % 10 = 0""",
)
def stream_malformed(spark, folder):
    """Every tenth delivery also lands as a line cut short; all of them reach the quarantine."""
    landing = files.new_folder(spark, "broken-landing")
    records = t.deliveries(spark, folder).drop("ingested_at")
    files.land_ndjson(envelope_to_record(records), landing)
    broken = t.posts(spark, folder).filter("event_id % 10 = 0")
    broken.select(F.concat(F.lit('{"event_id": "'), "event_id").alias("value")).write.mode("append").text(landing)
    bronze = ingest.read_event_stream(
        spark,
        landing,
        files.new_folder(spark, "broken-checkpoint"),
        path=files.new_folder(spark, "broken-bronze"),
    )
    rejected = dead_letter(bronze, t.contracts(spark), t.registry(spark)).filter("event_id IS NULL")
    return rejected.groupBy("rejection_reasons").agg(F.count("*").alias("lines"))


@query(
    "ensure_columns",
    """SELECT run_id, status, completed_at, CASE WHEN later THEN search_calls_remaining END
      AS search_calls_remaining
    FROM runs_v CROSS JOIN (VALUES (false), (true)) AS b(later)""",
)
def ensure_columns(spark, folder):
    """Run records of an older, narrower table stay beside those written after it grew."""
    table = _managed(spark, "runs")
    runs = t.runs(spark, folder)
    narrow = T.StructType([f for f in schemas.CONNECTOR_RUN.fields if "calls" not in f.name])
    for declared in (narrow, schemas.CONNECTOR_RUN):
        files.ensure_columns(spark, table, declared)
        columns = spark.table(table).columns
        files.conform(runs, declared).select(*columns).write.insertInto(table)
    return t.plain(
        spark.table(table).select("run_id", "status", "completed_at", "search_calls_remaining")
    )


@query(
    "refresh_table",
    """SELECT tenant_id, CAST(metric_date AS VARCHAR) AS metric_date, brand, mentions
    FROM brand_daily_v""",
)
def refresh_table(spark, folder):
    """Brand days that replace an earlier state of their table."""
    table = _managed(spark, "brand")
    brand = metrics.brand_daily(t.silver(spark, folder)).select(
        "tenant_id", "metric_date", "brand", "mentions"
    )
    for rows in (brand.filter("mentions > 1"), brand):
        files.refresh_table(rows, table, "brand days", partition_by=["tenant_id"])
    return t.plain(spark.table(table).select(*brand.columns))


@query(
    "init_tables",
    """SELECT tenant_id, platform, post_id, 'kept' AS review_notes FROM posts_v""",
)
def init_tables(spark, folder):
    """Labels written into the declared tables stay when the tables are declared again."""
    database = _managed(spark, "labels").split(".")[0]
    labels = t.posts(spark, folder).select("tenant_id", "platform", "post_id")
    labels = labels.withColumn("review_notes", F.lit("kept"))
    for _ in range(2):
        if "silver_human_labels" in " ".join(files.init_tables(spark, database)):
            conformed = files.conform(labels, schemas.HUMAN_LABELS)
            conformed.write.insertInto(f"{database}.silver_human_labels")
    return spark.table(f"{database}.silver_human_labels").select(*labels.columns)


def _managed(spark, name: str) -> str:
    """A table name in a new database of the session's warehouse."""
    database = f"tidemark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    return f"{database}.{name}"
