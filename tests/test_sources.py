import json
import uuid
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.queries import tables as t
from tidemark.sources import files, tables
from tidemark.streaming import ingest


def test_scratch_folders_come_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    folder = files.new_folder(spark, "x")
    assert folder.startswith(f"{configured}/x-") and folder != files.new_folder(spark, "x")


def test_inline_values_have_a_known_size(spark, plan_of):
    df = files.inline_values(spark, [], schemas.RECOMMENDATIONS)
    assert df.schema == schemas.RECOMMENDATIONS and df.isEmpty()
    assert "ExistingRDD" not in plan_of(df)


def test_stream_run_twice_reads_once(spark, tmp_path):
    landing, bronze, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "cp"))
    Path(landing).mkdir()
    line = {
        "event_id": "e1", "schema_version": "1.0", "tenant_id": "t",
        "occurred_at": "2026-08-08T11:55:00Z", "payload": "{}", "attributes": {"a": "b"},
        "unknown": 1,
    }
    Path(landing, "one.json").write_text(json.dumps(line) + "\n{broken\n")

    def drain():
        return ingest.read_event_stream(spark, landing, checkpoint, path=bronze)

    assert drain().count() == 2
    assert drain().count() == 2
    Path(landing, "two.json").write_text(json.dumps(line | {"event_id": "e2"}) + "\n")
    rows = drain()
    assert rows.count() == 3 and rows.filter("ingested_at is null").isEmpty()
    broken = rows.filter("event_id is null").first()
    assert broken.payload is None and broken.tenant_id is None
    first = rows.filter("event_id = 'e1'").first()
    assert first.occurred_at == datetime(2026, 8, 8, 11, 55) and first.attributes == {"a": "b"}


def test_stream_into_a_table(spark, tmp_path):
    Path(tmp_path, "in").mkdir()
    Path(tmp_path, "in", "a.json").write_text('{"run_id": "1", "status": "FAILED"}\n')
    bronze = ingest.read_run_metric_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "cp"), table="bronze_runs_test"
    )
    assert [(r.run_id, r.status) for r in bronze.collect()] == [("1", "FAILED")]
    stream = ingest.read_json_stream(spark, str(tmp_path / "in"), schemas.CONNECTOR_RUN)
    with pytest.raises(ValueError):
        ingest.append_available(stream, str(tmp_path / "cp2"))


def test_init_and_refresh_tables(spark):
    created = files.init_tables(spark, "control_test")
    assert len(created) == len(schemas.DURABLE_TABLES)
    assert files.init_tables(spark, "control_test") == []
    assert spark.table("control_test.decision_learnings").columns == schemas.LEARNINGS.names
    for n in (2, 3):
        files.refresh_table(spark.range(n).toDF("id"), "control_test.numbers", "it's small")
    assert spark.table("control_test.numbers").count() == 3
    described = spark.sql("DESCRIBE TABLE EXTENDED control_test.numbers")
    assert described.filter("col_name = 'Comment'").first().data_type == "it's small"


def test_missing_columns_are_added(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS evolve_test")
    name = "evolve_test.runs"
    old = T.StructType(schemas.CONNECTOR_RUN.fields[:9])
    files.ensure_columns(spark, name, old)
    assert spark.table(name).columns == old.names
    files.ensure_columns(spark, name, schemas.CONNECTOR_RUN)
    files.ensure_columns(spark, name, schemas.CONNECTOR_RUN)
    assert spark.table(name).columns == schemas.CONNECTOR_RUN.names


def test_conform_keeps_extra_columns(rows):
    df = files.conform(rows("status STRING, zone STRING", ("ok", "z")), schemas.CONNECTOR_RUN)
    assert df.columns == [*schemas.CONNECTOR_RUN.names, "zone"]
    row = df.first()
    assert (row.status, row.zone, row.run_id) == ("ok", "z", None)


@pytest.mark.parametrize("name", ["a b", "x;drop", "1x", "a-b", ""])
def test_identifiers_are_checked(name):
    with pytest.raises(ValueError):
        files.qualified(name)


def test_projection_reads(spark, rows, tmp_path):
    spark.range(1500).createOrReplaceTempView("serving_metrics")
    assert files.read_projection(spark, "metrics").count() == 1500
    with pytest.raises(ValueError):
        files.read_projection(spark, "secrets")
    with pytest.raises(ValueError):
        files.read_projection(spark, "metrics", view="a; b")
    df = rows("tenant_id STRING, metric_name STRING, value DOUBLE", ("t", "m", 1.5), ("t", "n", None))
    for order in (None, [F.asc("metric_name")]):
        path = str(tmp_path / f"export-{order is None}")
        files.export_projection(df, path, page_order=order)
        back = files.read_projection_snapshot(spark, path, df.schema)
        assert sorted(tuple(r) for r in back.collect()) == [("t", "m", 1.5), ("t", "n", None)]
    page = json.loads(files.projection_document(df, [F.desc("metric_name")], 1).first().value)
    assert [i["metric_name"] for i in page["items"]] == ["n"]
    assert page["available"] == 2 and page["has_more"] is True
    many = spark.range(5000).toDF("id")
    paths = files.export_projections({"metrics": many, "evidence": many}, str(tmp_path / "all"))
    assert sorted(paths) == ["evidence", "metrics"]
    assert files.read_projection_snapshot(spark, paths["metrics"], many.schema).count() == 5000
    with pytest.raises(ValueError):
        files.export_projections({"secrets": many}, str(tmp_path / "no"))
    absent = files.read_projection_snapshot(spark, str(tmp_path / "none"), df.schema)
    assert absent.isEmpty() and absent.schema == df.schema
    Path(tmp_path, "list").mkdir()
    Path(tmp_path, "list", "a.json").write_text('[{"tenant_id": "t", "value": 2.0}]')
    assert files.read_projection_snapshot(spark, str(tmp_path / "list"), df.schema).count() == 1


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_replaced_tables(spark, database, monkeypatch):
    mart = f"{database}.mart"
    assert not tables.exists(spark, mart)
    assert tables.publish_replace(spark.range(5), mart) == 5
    assert tables.publish_replace(spark.range(0), mart) == 0
    assert tables.read_mart(spark, mart).count() == 5
    # a run may read what it replaces, and readers of the version before may go on
    before = spark.table(mart)
    assert tables.publish_replace(before.filter("id > 2"), mart) == 2
    assert tables.read_mart(spark, mart).count() == 2 and before.count() == 5
    found = tables.replace_table(spark.range(0), mart, metrics={"top": F.max("id")})
    assert found == {"n": 0, "top": None} and tables.read_mart(spark, mart).isEmpty()
    assert len(tables._versions(spark, mart)) == 3
    monkeypatch.setattr(tables, "KEEP_DAYS", -1)
    tables.publish_replace(spark.range(1), mart)
    assert len(tables._versions(spark, mart)) == 2 and tables.read_mart(spark, mart).count() == 1


def test_failed_publish_leaves_the_mart(spark, database):
    mart = f"{database}.mart"
    tables.publish_replace(spark.range(3), mart)
    broken = spark.range(3).select(
        F.when(F.col("id") == 2, F.raise_error(F.lit("boom")).cast("bigint"))
        .otherwise(F.col("id"))
        .alias("id")
    )
    with pytest.raises(Exception, match="boom"):
        tables.publish_replace(broken, mart)
    assert tables.read_mart(spark, mart).count() == 3
    assert tables.publish_replace(spark.range(4), mart) == 4


def test_only_touched_parts_are_rewritten(spark, rows, database):
    table = f"{database}.facts"
    ddl = "k STRING, v INT, day STRING"
    tables.overwrite_parts(rows(ddl, ("a", 1, "d1"), ("b", 2, "d2"), ("c", 3, "d3")), table, "day", [])
    files_of = lambda: {p for p in spark.table(table).filter("day <> 'd2'").inputFiles()}
    before = files_of()
    held = spark.table(table).filter("day = 'd2'")
    tables.overwrite_parts(held.unionByName(rows(ddl, ("x", 9, "d2"))), table, "day", ["d2"])
    assert files_of() == before
    assert sorted(r.k for r in spark.table(table).collect()) == ["a", "b", "c", "x"]
    tables.overwrite_parts(rows(ddl), table, "day", ["d1", "none"])
    assert sorted(r.k for r in spark.table(table).collect()) == ["b", "c", "x"]
    with pytest.raises(ValueError, match="more than"):
        held = tables.MOST_PARTS
        try:
            tables.MOST_PARTS = 1
            tables.values_of(spark.table(table), "day")
        finally:
            tables.MOST_PARTS = held


def test_merged_tables(spark, rows, database, plan_of):
    mart, ddl = f"{database}.facts", "k STRING, v INT"
    assert tables.publish(rows(ddl, ("a", 1), ("b", 2), (None, 7)), mart, ["k"]) == 3
    tables.publish(rows(ddl, ("b", 20), ("c", 30), (None, 8)), mart, ["k"])
    assert tables.publish(rows(ddl), mart, ["k"]) == 0
    got = sorted((tuple(r) for r in tables.read_mart(spark, mart).collect()), key=repr)
    assert got == [("a", 1), ("b", 20), ("c", 30), (None, 7), (None, 8)]
    with pytest.raises(Exception, match="several rows"):
        tables.publish(rows(ddl, ("z", 1), ("z", 2)), f"{database}.new", ["k"])
    assert not [t for t in spark.catalog.listTables(database) if "staged" in t.name]
    days = rows("k STRING, metric_date DATE, v INT", ("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 2), 2))
    tables.publish(days, f"{database}.days", ["k", "metric_date"])
    first = spark.table(f"{database}.days").filter("part = '2024-01-01'").inputFiles()
    tables.publish(days.filter("v = 2").withColumn("v", F.lit(5)), f"{database}.days", ["k", "metric_date"])
    assert spark.table(f"{database}.days").filter("part = '2024-01-01'").inputFiles() == first
    assert {r.v for r in spark.table(f"{database}.days").collect()} == {1, 5}


def test_a_merge_exchanges_no_target(spark, rows, database, plan_of):
    tables.publish(spark.range(10_000).withColumn("v", F.lit(1)), f"{database}.big", ["id"])
    small = spark.range(3).withColumn("v", F.lit(2)).withColumn("part", tables.part_of(["id"]))
    spark.sql(f"DROP TABLE IF EXISTS {database}.small")
    small.write.saveAsTable(f"{database}.small")
    plan = plan_of(tables.merged_parts(spark.table(f"{database}.big"), spark.table(f"{database}.small"), ["id"]))
    assert "BroadcastHashJoin" in plan and plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def test_row_counts_are_one_job(spark, folder):
    counts = files.table_row_counts({"a": spark.range(3), "b": t.runs(spark, folder)})
    assert {r.table_name: r.row_count for r in counts.collect()}["a"] == 3


def test_a_replayed_batch_replaces_itself(spark, folder, database, tmp_path):
    """The last batch loses its commit, as if the run had ended between writing and noting it."""
    runs, table = t.runs(spark, folder), f"{database}.runs"
    landing, checkpoint = str(tmp_path / "landing"), tmp_path / "checkpoint"
    for n, half in enumerate(("status = 'FAILED'", "status <> 'FAILED'")):
        files.land_ndjson(runs.filter(half), landing, files=1)
        stream = ingest.read_json_stream(spark, landing, schemas.CONNECTOR_RUN)
        ingest.write_batches(stream, str(checkpoint), table).awaitTermination()
    assert spark.table(table).count() == runs.count()
    assert sorted(r[0] for r in spark.table(table).select("batch").distinct().collect()) == [f"{n:012d}" for n in range(2)]
    before = sorted(spark.table(table).select("run_id", "batch").collect())
    for name in ("1", ".1.crc"):
        (checkpoint / "commits" / name).unlink()
    stream = ingest.read_json_stream(spark, landing, schemas.CONNECTOR_RUN)
    ingest.write_batches(stream, str(checkpoint), table).awaitTermination()
    assert sorted(spark.table(table).select("run_id", "batch").collect()) == before


def test_a_continuous_query_takes_in_what_lands_later(spark, folder, database, tmp_path):
    runs, landing = t.runs(spark, folder), str(tmp_path / "landing")
    files.land_ndjson(runs.filter("status = 'FAILED'"), landing)
    stream = ingest.read_json_stream(spark, landing, schemas.CONNECTOR_RUN)
    running = ingest.write_batches(stream, str(tmp_path / "cp"), f"{database}.runs", "100 milliseconds")
    try:
        running.processAllAvailable()
        first = spark.table(f"{database}.runs").count()
        files.land_ndjson(runs.filter("status <> 'FAILED'"), landing)
        running.processAllAvailable()
        assert running.isActive and 0 < first < spark.table(f"{database}.runs").count() == runs.count()
    finally:
        running.stop()
