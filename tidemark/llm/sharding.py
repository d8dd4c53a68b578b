"""Shards of documents in random order, by a two-pass external shuffle with DataFrame functions alone.

1. *Scatter.* A seeded hash deals every row into one of n buckets, n being all bytes over
   `BUCKET_BYTES`, so that a bucket fits into the memory of one task. This is the only exchange of texts.
2. *Shuffle.* Each bucket is put into a fixed order and then permuted by Fisher-Yates (Spark's
   `shuffle`, seeded by the bucket's number, which is its partition), and written.

Buckets follow each other in one sequence; the shards are its equal runs (law `rows`: their row
counts are at most one apart), so that every shard is written bucket by bucket.

The hash takes doc_id and text. Rows that repeat both are numbered, and the number takes part in the
hash: a row that fills a third of the table is scattered as evenly as any other. The order depends on
the rows and the seed alone, not on how the table is split; only rows equal in doc_id and text may
change places.

Null texts are files' nulls and count one byte; a null doc_id is a value like any other. An empty table
makes empty shards. The caller's columns are kept in one struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import KEY, key, occurrences, settle

SHARDS = 8
SEED = 20_240_731
#: Text bytes of a bucket. A task holds one bucket, about six times as rows, array and written copies: this
#: suits 1 GB of heap a core; with 16 GB, give 256 MB. The buckets' number, and so the order, follows from it.
BUCKET_BYTES = 16 << 20
#: Buckets whose offsets are added up in one group.
OFFSET_GROUP = 1 << 12


def size() -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, base): rows in all earlier buckets, added up in groups and then over the groups."""
    grouped = counts.withColumn("group", F.floor(F.col("bucket") / OFFSET_GROUP))
    earlier = Window.unboundedPreceding, -1
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(*earlier))
    totals = grouped.groupBy("group").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("group").rowsBetween(*earlier))
    totals = totals.select("group", F.coalesce(before, F.lit(0)).alias("base"))
    grouped = grouped.select("bucket", "group", F.coalesce(inside, F.lit(0)).alias("inside"))
    return grouped.join(totals, "group").select("bucket", (F.col("base") + F.col("inside")).alias("base"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row as (doc, shard, slot): `doc` holds the caller's columns, slots of a shard run from 0."""
    rows = docs.select(F.struct("*").alias("doc"), *key())
    keys = settle(docs.select(*key(), size().alias("size")).groupBy(*KEY, "size").count())
    total = keys.agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("size")).alias("bytes")).first()
    n_rows, n_buckets = total["rows"] or 0, max(1, -(-(total["bytes"] or 0) // bucket_bytes))

    def bucket(copy: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *KEY, copy), F.lit(n_buckets)).cast("int").alias("bucket")

    first, repeated = F.lit(0).cast("long"), keys.filter("count > 1").select(*KEY)
    counted = keys.filter("count = 1").select(bucket(first))
    if repeated.isEmpty():
        rows = rows.withColumn("copy", first)
    else:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
        copies = occurrences(rows, settle(repeated), KEY)
        counted = counted.unionByName(copies.select(bucket(F.col("copy"))))
        rows = rows.join(copies.drop(*KEY), "row", "left").withColumn("copy", F.coalesce("copy", first))
    offsets = settle(_offsets(counted.groupBy("bucket").agg(F.count("*").alias("n"))))

    dealt = rows.select(bucket(F.col("copy")), *KEY, "copy", "doc").repartitionById(n_buckets, "bucket")
    held = dealt.groupBy("bucket").agg(F.collect_list(F.struct(*KEY, "copy", "doc")).alias("rows"))
    marks = F.transform("rows", lambda r, i: F.struct(*(r[c] for c in (*KEY, "copy")), i.alias("at")))
    held = held.select("bucket", "rows", F.shuffle(F.sort_array(marks), seed).alias("order"))
    drawn = F.transform("order", lambda o: F.get(F.col("rows"), o["at"])["doc"])
    placed = held.select("bucket", drawn.alias("drawn")).join(offsets, "bucket")
    placed = placed.select("base", F.posexplode("drawn").alias("pos", "doc"))
    place = F.col("base") + F.col("pos")
    shard = F.expr(f"(({shards} * (base + pos + 1)) - 1) div {max(n_rows, 1)}")
    start = F.expr(f"(shard * {n_rows}L) div {shards}")
    return placed.select("doc", place.alias("place"), shard.cast("int").alias("shard")).select(
        "doc", "shard", (F.col("place") - start).alias("slot")
    )


def write_shards(
    docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Write one folder per shard; in its files, rows ascend by slot."""
    rows = shuffled(docs, shards, seed, bucket_bytes)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(doc, slot, shard) of every row in the files; `schema` is that of the documents written."""
    stored = T.StructType([T.StructField("doc", schema), T.StructField("slot", T.LongType())])
    return spark.read.schema(stored.add("shard", T.IntegerType())).parquet(folder)


def digest(stored: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    rows = stored.select("doc.doc_id", "doc.text", "shard", "slot")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
