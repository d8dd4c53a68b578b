"""Benchmark decontamination with DataFrame functions alone.

Words are runs of ASCII digits and letters and of all characters beyond ASCII, ASCII letters in
lower case. A window is `WINDOW` consecutive words of a benchmark item, or all words of a shorter
item. The scan has two steps:

1. *Screen.* Windows of ten words always contain a whole aligned group of five words of the
   document, one that starts at a multiple of five. So every fifth position is looked up in a hash
   set of all five-word groups of the benchmark, instead of every position. Items under nine words
   use shorter groups with a smaller stride, by the same argument.
2. *Verify.* Documents with a group in common have all their windows compared with the benchmark's,
   word by word.

The hash set is broadcast only while its counted rows stay below `BROADCAST_ROWS` (16 bytes each);
a larger benchmark meets the corpus in a shuffled join that Spark may split where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, keyed, packed, settle, texts

WINDOW = 10
BROADCAST_ROWS = 1 << 19

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_lower(word: Column) -> Column:
    beyond = F.octet_length(word) != F.length(word)
    return F.when(beyond, F.translate(word, UPPER, UPPER.lower())).otherwise(F.lower(word))


WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), _ascii_lower)


def _starts(array: Column, width: Column | int, stride: int = 1) -> Column:
    """Start positions of the array's windows of a width; none where it is shorter."""
    last = F.size(array) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _span(array: Column, start: Column, width: Column | int) -> Column:
    return F.slice(array, start + 1, F.lit(width) if isinstance(width, int) else width)


def _group_hashes(array: Column, width: int, stride: int) -> Column:
    return F.transform(_starts(array, width, stride), lambda i: F.xxhash64(_span(array, i, width)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, width, gram) windows; items without words have none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.lit(window), F.size("w")))
    starts = _starts(F.col("w"), F.col("width"))
    return items.select("item_id", "width", "w", F.explode(starts).alias("at")).select(
        "item_id", "width", _span(F.col("w"), F.col("at"), F.col("width")).alias("gram")
    ).distinct()


def _sized(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def contaminated_spans(docs: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, at, width, item_id) of every window that occurs in a document of `docs(key, text)`."""
    windows = settle(windows.withColumn("h", F.xxhash64("gram")))
    sizes = [r.width for r in windows.select("width").distinct().collect()]  # at most WINDOW of them
    screens = []
    # One part per group width: all windows of 9 or 10 words share the groups of five.
    for part in sorted({(w + 1) // 2 for w in sizes}):
        own = windows.filter(F.floor((F.col("width") + 1) / 2) == part)
        stride = min(w for w in sizes if (w + 1) // 2 == part) - part + 1
        parts = own.select(F.explode(_starts(F.col("gram"), part)).alias("at"), "gram")
        parts = settle(parts.select(F.xxhash64(_span(F.col("gram"), F.col("at"), part)).alias("h")).distinct())
        seen = docs.select(*KEY, words(F.col("text")).alias("w")).select(
            *KEY, F.explode(_group_hashes(F.col("w"), part, stride)).alias("h")
        )
        screens.append(seen.join(_sized(parts, broadcast_rows), "h", "left_semi").select(*KEY))
    if not screens:
        return docs.select(*KEY, F.lit(0).alias("at"), F.lit(0).alias("width")).withColumn(
            "item_id", F.lit(None).cast(windows.schema["item_id"].dataType)
        ).filter(F.lit(False))
    suspects = screens[0]
    for more in screens[1:]:
        suspects = suspects.unionByName(more)
    suspects = settle(suspects.distinct())
    held = docs.join(suspects, KEY, "left_semi").select(*KEY, words(F.col("text")).alias("w"))
    spots = None
    for width in sorted(sizes):
        own = held.select(*KEY, "w", F.explode(_starts(F.col("w"), width)).alias("at")).select(
            *KEY, "at", _span(F.col("w"), F.col("at"), width).alias("found")
        )
        own = own.withColumns({"h": F.xxhash64("found"), "width": F.lit(width)})
        spots = own if spots is None else spots.unionByName(own)
    known = _sized(windows.withColumnRenamed("width", "wide"), broadcast_rows)
    hits = spots.join(known, "h").filter((F.col("width") == F.col("wide")) & (F.col("found") == F.col("gram")))
    return settle(hits.select(*KEY, "at", "width", "item_id").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: key, doc_id, n_words, hit word positions, and the items found.

    Null and empty texts have no words and are clean. Rows that repeat share one verdict.
    """
    read = keyed(docs, texts())
    spans = contaminated_spans(read.select(*KEY, "text"), benchmark_windows(benchmark, window))
    reach = F.sequence("at", F.col("at") + F.col("width") - 1)
    hit = spans.select(*KEY, "at", "width").distinct().select(*KEY, F.explode(reach).alias("at")).distinct()
    hit = hit.groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("hits"))
    items = spans.select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = settle(hit.join(items, KEY))
    nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    return read.select(*KEY, "doc_id", F.regexp_count("text", F.lit(WORD)).alias("n_words")).join(found, KEY, "left").select(
        *KEY,
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hits", nothing[0]).alias("hits"),
        F.coalesce("items", nothing[1]).alias("items"),
    )


def removed_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, without contaminated documents."""
    return _apply(docs, benchmark, window, spans=False)


def removed_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`; contaminated texts keep only words outside of hits, joined by a space."""
    return _apply(docs, benchmark, window, spans=True)


def _apply(docs: DataFrame, benchmark: DataFrame, window: int, spans: bool) -> DataFrame:
    found = contamination(docs, benchmark, window).filter(F.size("hits") > 0)
    found = settle(found.select(*KEY, "hits").dropDuplicates(KEY))
    rows = packed(docs)
    if not spans:
        return rows.join(found, KEY, "left_anti").select("row.*")
    own = F.col("row")["text"]
    kept = F.filter(words(own), lambda w, i: ~F.array_contains(F.col("hits"), i))
    text = F.when(F.col("hits").isNull(), own).otherwise(F.array_join(kept, " "))
    return rows.join(found, KEY, "left").select(F.col("row").withField("text", text).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
