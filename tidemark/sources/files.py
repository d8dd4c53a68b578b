"""Landing files and managed tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
PROJECTIONS = ("opportunities", "evidence", "metrics", "pipeline_status")
PAGE_SIZE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it.

    Read from ``spark.checkpoint.dir``. Where a local session leaves it unset, it is set here,
    once, to a new folder; a cluster has to name it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Path of a folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def identifier(name: str) -> str:
    """The name, if it is a plain SQL identifier."""
    if not IDENTIFIER.fullmatch(str(name)):
        raise ValueError(f"not a plain SQL identifier: {name!r}")
    return name


def qualified(*parts: str) -> str:
    """Dotted table name of plain identifiers, quoted."""
    return ".".join(f"`{identifier(p)}`" for p in parts)


def inline_values(
    spark: SparkSession, rows: Sequence[tuple], schema: T.StructType
) -> DataFrame:
    """A literal relation with a declared schema.

    Built from Arrow, it is a local relation whose exact size the optimizer knows, so that
    control tables made of literals join by broadcast. Rows handed to Spark as Python
    objects would count as unboundedly large.
    """
    columns = {}
    for i, f in enumerate(schema.fields):
        values = [row[i] for row in rows]
        if isinstance(f.dataType, T.MapType):  # a dict alone would become a struct
            pairs = [None if v is None else list(v.items()) for v in values]
            columns[f.name] = pa.array(pairs, pa.map_(pa.string(), pa.string()))
        else:
            columns[f.name] = values
    return spark.createDataFrame(pa.table(columns), schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the path's own file system."""
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(context._jsc.hadoopConfiguration()).exists(location)


def land_ndjson(
    records: DataFrame, path: str, files: int | None = None, mode: str = "append"
) -> None:
    """Write records as newline-delimited JSON files.

    ``files`` bounds the number of files of a small batch; left out, every task writes
    its own file and the batch size sets the parallelism.
    """
    batch = records.coalesce(files) if files else records
    batch.write.mode(mode).options(**schemas.JSON_TIMES).json(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the declared columns first, missing ones as typed NULLs.

    Columns that are not declared stay behind them (additive evolution).
    """
    present = {c.lower(): c for c in df.columns}
    declared = [
        F.col(present[f.name.lower()]).alias(f.name)
        if f.name.lower() in present
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    names = {f.name.lower() for f in schema.fields}
    extra = [c for c in df.columns if c.lower() not in names]
    return df.select(*declared, *extra)


def ensure_columns(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Create the table when absent; otherwise add the declared columns it lacks."""
    name = qualified(*table.split("."))
    if not spark.catalog.tableExists(table):
        inline_values(spark, [], schema).write.format("parquet").saveAsTable(table)
        return
    existing = {f.name.lower() for f in spark.table(table).schema.fields}
    missing = [f for f in schema.fields if f.name.lower() not in existing]
    if missing:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")


def init_tables(spark: SparkSession, database: str) -> list[str]:
    """Declare the durable control, decision and label tables; existing ones stay."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {qualified(database)}")
    created = []
    for name, schema in schemas.DURABLE_TABLES.items():
        table = f"{database}.{name}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
                for f in schema.fields
            )
            spark.sql(f"CREATE TABLE {qualified(database, name)} ({columns}) USING parquet")
            created.append(table)
    return created


def refresh_table(
    df: DataFrame, table: str, comment: str, partition_by: Sequence[str] = ()
) -> None:
    """Replace a managed table by the result of ``df`` and describe it."""
    writer = df.write.format("parquet").mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    text = comment.replace("'", "\\'")
    df.sparkSession.sql(f"COMMENT ON TABLE {qualified(*table.split('.'))} IS '{text}'")


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def read_projection(
    spark: SparkSession, name: str, database: str | None = None, view: str | None = None
) -> DataFrame:
    """All rows of a serving projection; names must be plain identifiers."""
    if name not in PROJECTIONS:
        raise ValueError(f"unknown projection: {name!r}")
    parts = [identifier(view or f"serving_{name}")]
    if database:
        parts.insert(0, identifier(database))
    return spark.table(".".join(parts))


def projection_document(
    projection: DataFrame, order: Sequence[Column], page_size: int = PAGE_SIZE
) -> DataFrame:
    """One JSON document: the first rows by ``order``, and whether rows remain.

    ``{"items": [...], "available": n, "has_more": true}``; ``order`` should end in a row id.
    Only the page's rows meet in one task.
    """
    columns = projection.columns
    page = projection.orderBy(*order).limit(page_size).select(F.struct(*columns).alias("row"))
    items = page.agg(F.collect_list("row").alias("items"))
    available = projection.agg(F.count(F.lit(1))).scalar()
    document = F.struct(
        "items", available.alias("available"), (available > page_size).alias("has_more")
    )
    return items.select(F.to_json(document, schemas.JSON_TIMES).alias("value"))


def export_projection(
    projection: DataFrame,
    path: str,
    page_order: Sequence[Column] | None = None,
    page_size: int = PAGE_SIZE,
) -> None:
    """Export all rows of a projection as NDJSON, each task its own file.

    With ``page_order`` the export is the first page alone, as one document that says
    whether rows remain.
    """
    if page_order is None:
        projection.write.mode("overwrite").options(**schemas.JSON_TIMES).json(path)
    else:
        page = projection_document(projection, page_order, page_size)
        page.write.mode("overwrite").text(path)


def export_projections(projections: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Export every serving projection completely, each to its own folder; their paths."""
    unknown = set(projections) - set(PROJECTIONS)
    if unknown:
        raise ValueError(f"unknown projections: {sorted(unknown)}")
    paths = {name: f"{folder}/{name}" for name in PROJECTIONS if name in projections}
    for name, path in paths.items():
        export_projection(projections[name], path)
    return paths


def read_projection_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Rows of an exported projection; absent → empty.

    A line is a row, an array of rows or an ``{"items": [...]}`` page. ``multi_line`` reads
    files that are one such document over several lines.
    """
    wrapped = T.StructType(
        [T.StructField("items", T.ArrayType(schema)), *schema.fields]
    )
    if not path_exists(spark, path):
        return inline_values(spark, [], schema)
    documents = spark.read.schema(wrapped).json(path, multiLine=multi_line)
    names = [f.name for f in schema.fields]
    listed = documents.filter(F.col("items").isNotNull()).select(F.inline("items"))
    bare = documents.filter(
        F.col("items").isNull() & reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
    ).select(*names)
    return listed.unionByName(bare)
