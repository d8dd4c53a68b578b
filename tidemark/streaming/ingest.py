"""Incremental JSON ingestion: declared schema in, append-only bronze out.

File streams keep their progress in the checkpoint, so every landed file enters bronze
exactly once however often the job runs. Deliveries themselves are at least once;
``dedup_deliveries`` makes the tables behind idempotent. A line that is no JSON becomes
an all-NULL row, which the quarantine then lists with every reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.sources import tables

FILES_PER_TRIGGER = 10_000
#: Bronze is laid out by day of ingestion, so that a run reads the days it lacks.
DAY = "ingested_day"


def read_json_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Stream of landed JSON lines with ``ingested_at`` and its UTC day.

    A micro-batch takes at most so many files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path).withColumns(
        {"ingested_at": F.current_timestamp(), DAY: F.to_date(F.current_timestamp())}
    )


def append_available(
    stream: DataFrame,
    checkpoint: str,
    *,
    table: str | None = None,
    path: str | None = None,
    processing_time: str | None = None,
):
    """Append the stream to a table or a Parquet folder; the started query.

    Available-now by default: everything landed so far, in bounded micro-batches, then
    stop. ``processing_time`` runs it continuously instead.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table or a path")
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    writer = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .partitionBy(*[c for c in (DAY,) if c in stream.columns])
        .trigger(**trigger)
    )
    return writer.toTable(table) if table else writer.start(path)


#: Partition of a batch in a table that ``write_batches`` fills.
BATCH = "batch"


def write_batches(
    stream: DataFrame, checkpoint: str, table: str, processing_time: str | None = None
):
    """Write every micro-batch as a partition of its own, named by its number; the started query.

    A batch that Spark replays, because a run was lost between writing and noting it, replaces its
    own partition: the table holds every batch exactly once. Without ``processing_time`` the query takes in
    what has landed and stops; with it, it goes on, a batch per interval.
    """

    def write(rows: DataFrame, number: int) -> None:
        part = f"{number:012d}"
        tables.overwrite_parts(rows.withColumn(BATCH, F.lit(part)), table, BATCH, [part])
        stream.sparkSession.catalog.refreshTable(table)  # batches run in a session of their own

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def _drain(stream: DataFrame, checkpoint: str, table: str | None, path: str | None) -> None:
    append_available(stream, checkpoint, table=table, path=path).awaitTermination()


def read_event_stream(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    *,
    table: str | None = None,
    path: str | None = None,
    max_files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Drain landed event envelopes into bronze; the bronze DataFrame."""
    stream = read_json_stream(spark, landing, schemas.EVENT_ENVELOPE, max_files_per_trigger)
    _drain(stream, checkpoint, table, path)
    return spark.table(table) if table else spark.read.parquet(path)


def read_run_metric_stream(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    *,
    table: str | None = None,
    path: str | None = None,
    max_files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Drain landed connector-run records into bronze; the bronze DataFrame."""
    stream = read_json_stream(spark, landing, schemas.CONNECTOR_RUN, max_files_per_trigger)
    _drain(stream, checkpoint, table, path)
    return spark.table(table) if table else spark.read.parquet(path)
