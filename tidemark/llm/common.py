"""Shared helpers of the corpus operators: scratch tables in the shared folder and row keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space as the contracts name it, for Java and RE2 expressions alike.
BLANK = r"\x20\x09-\x0D"

#: Arrow batches by bytes, where the caller's configuration says nothing: rows are texts of any length.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

#: Key columns that `keyed` adds; the names keep clear of columns that callers bring.
KEY = ["_k1", "_k2"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors must see.

    Only a local session may leave the setting out; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python functions import it."""
    if getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    spark.sparkContext._tidemark_shipped = True


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor, ids that were dealt out
    while writing stay fixed, and Spark knows the true size of what it reads.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def key() -> list[Column]:
    """The key of a row, derived from its doc_id and text alone.

    Rows that share a key are equal in both, so a result found for the key holds for each of them.
    """
    doc_id = F.col("doc_id").cast("long")
    return [
        F.coalesce(doc_id, F.lit(-1)).alias(KEY[0]),
        F.xxhash64(doc_id.isNull(), F.col("text")).alias(KEY[1]),
    ]


def keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Key, ``doc_id`` and the columns asked for. The caller's other columns cannot clash."""
    return docs.select(*key(), F.col("doc_id").cast("long").alias("doc_id"), *columns)


def packed(docs: DataFrame) -> DataFrame:
    """Key and the caller's whole row as one struct `row`, so that no name of the caller's can clash."""
    return docs.select(*key(), F.struct("*").alias("row"))


def besides_text(docs: DataFrame) -> Column:
    """Order of packed rows that share a key: by all their columns but the text, which is equal."""
    others = [F.col("row")[c].alias(c) for c in docs.columns if c != "text"]
    return F.to_json(F.struct(*others))


def occurrences(rows: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """(row, keys, copy): the number of each row of a settled table among the rows of its keys.

    `row` comes from `monotonically_increasing_id` and names the task that wrote the row, so rows are
    counted by keys and writing task first, and no task sees all copies of a key. Only rows whose keys are
    in `repeated` are numbered. Keys have no nulls.
    """
    held = rows.select("row", *keys).join(repeated, keys, "left_semi").withColumn("part", F.shiftright("row", 33))
    counts = held.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "part").orderBy("row")
    copies = held.withColumn("at", F.row_number().over(inside) - 1).join(bases, [*keys, "part"])
    return settle(copies.select("row", *keys, (F.col("base") + F.col("at")).alias("copy")))


def texts() -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id's decimal text has the remainder; a null doc_id never has."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column_bytes(column) -> tuple:
    """Data and offsets of an Arrow string or binary column as numpy arrays, without a copy."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def sliced(batches: Iterator, column: str, most: int) -> Iterator:
    """Arrow batches cut into slices of about `most` bytes in one text column, a row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = column_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
