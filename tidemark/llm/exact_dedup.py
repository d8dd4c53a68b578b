"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of fixed size. The distinct blocks are sorted and their
place becomes an integer name; then adjacent names are paired, the distinct pairs sorted and named
in turn, until each document is left with one name. Two documents have the same number of blocks
and the same last name exactly when their texts are equal: names come from sorted distinct
values, never from a hash, so there is no collision to fear.

The whole text of a block crosses the network once, to be sorted. Documents refer to their blocks
by a 128-bit fingerprint that is *checked* to be injective on the sorted blocks; if two different
blocks ever share one, the level is named again under another seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, settle

BLOCK_CHARS = 4096


def normalised() -> Column:
    """Text with each run of ASCII white space as one space; null is empty."""
    runs = rf"[\x09-\x0D][{BLANK}]*|\x20[{BLANK}]+"
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), runs, " ")


def _blocks(text: Column, size: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _print(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)]


def _name_blocks(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their blocks' fingerprints, and the integer name of each fingerprint."""
    seed = 0
    while True:
        units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
        blocks = _blocks(F.col("text"), size)
        distinct = (
            units.select(F.explode(blocks).alias("block"))
            .select(*(c.alias(n) for c, n in zip(_print(F.col("block"), seed), "hg")), "block")
            .distinct()
        )
        names = settle(
            distinct.sortWithinPartitions("block").select("h", "g", F.monotonically_increasing_id().alias("name"))
        )
        if names.groupBy("h", "g").count().filter("count > 1").isEmpty():
            break
        seed += 1
    marks = F.transform(
        blocks, lambda b: F.struct(*(c.alias(n) for c, n in zip(_print(b, seed), "hg")))
    )
    units = settle(
        units.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
            marks.alias("marks"),
        )
    )
    return units, names


def _regroup(named: DataFrame) -> DataFrame:
    """One array of names per document, in order; a group holds one document's own blocks."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("row").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def _name_pairs(level: DataFrame) -> DataFrame:
    """Names one level up: the distinct adjacent pairs, sorted and numbered."""
    half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
    left, right = lambda i: F.get("names", 2 * i), lambda i: F.coalesce(F.get("names", 2 * i + 1), F.lit(-1))
    pairs = F.transform(half, lambda i: F.struct(left(i).alias("l"), right(i).alias("r")))
    flat = level.select("row", F.posexplode(pairs).alias("pos", "pair")).select("row", "pos", "pair.*")
    names = settle(
        flat.select("l", "r")
        .distinct()
        .sortWithinPartitions("l", "r")
        .select("l", "r", F.monotonically_increasing_id().alias("name"))
    )
    return settle(_regroup(flat.join(names, ["l", "r"]).select("row", "pos", "name")))


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Collision-free identity (n_blocks, name) of each row's normalised text.

    Repeated rows keep one row each; a null text is an empty one and has one empty block.
    """
    units, names = _name_blocks(docs, block_chars)
    flat = units.select("row", F.posexplode("marks").alias("pos", "mark")).select("row", "pos", "mark.*")
    level = settle(_regroup(flat.join(names, ["h", "g"]).select("row", "pos", "name")))
    done = None
    while True:
        ready = level.filter(F.size("names") == 1).select("row", F.get("names", F.lit(0)).alias("name"))
        done = ready if done is None else done.unionByName(ready)
        rest = level.filter(F.size("names") > 1)
        if rest.isEmpty():
            break
        level = _name_pairs(rest)
    return settle(
        units.select("row", "doc_id", "text_sha256", F.size("marks").alias("n_blocks")).join(done, "row")
    )


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: who stays of each group of equal texts.

    The smallest doc_id stays (null last); of repeated rows with that doc_id, one.
    Returns doc_id, keep_id, group_size, kept, text_sha256, n_blocks.
    """
    named = document_names(docs, block_chars)
    groups = named.groupBy("n_blocks", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("group_size")
    )
    # The derived key hides how the groups lie: both sides are exchanged and hot keys can be split.
    identity = F.concat_ws(":", "n_blocks", "name")
    groups = groups.select(identity.alias("identity"), "first", "group_size")
    return (
        named.withColumn("identity", identity)
        .join(groups, "identity")
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("first.row")).alias("kept"),
            "text_sha256",
            F.col("n_blocks").cast("long").alias("n_blocks"),
        )
    )
