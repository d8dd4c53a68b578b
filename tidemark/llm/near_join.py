"""N-gram Jaccard join: MinHash LSH in bands, then exact verification.

Documents are sets of `SHINGLE`-word shingles; two are linked when their Jaccard similarity is at
least `threshold`. Words are runs of ASCII digits, ASCII letters (in lower case) and all characters beyond
ASCII. A text of fewer words has one shingle of all its words; a text without words has none, is
linked to nothing and is a group of its own.

1. *Copies.* Documents with the same shingle set become one set; only sets go on.
2. *Bands.* Each of `trees` bands names a set by its first `prefix` of `depth` MinHash values. One prefix
   holds for all: the longest with which a pair at the threshold meets in some band with the target
   recall. Sets that share a band's prefix meet in a node. The values behind it serve the screen alone.
3. *Screen.* Within a node, signatures are compared. Pairs whose estimate is far below the threshold
   (`MARGIN`) fall; of the others only a star per connected part is kept. Their connected
   components are the candidate groups: any pair that met and passed is inside of one.
4. *Verification.* Inside a candidate group all pairs are compared exactly, by matrix products of
   shingle incidences. Each set learns how many documents it is linked to, and verified links give
   the final groups. No row per pair is ever made.

Nodes and groups beyond a block of sets are dealt out as pairs of blocks, so neither a task nor a
group holds more than two blocks, whatever share of the corpus is similar. Every copy counts:
`n_links` is the number of other documents at or above the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, besides_text, keyed, packed, settle, sliced, texts

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES = 24
DEPTH = 6
MARGIN = 0.25
NODE_BLOCK = 1536
GROUP_BLOCK = 512
SLICE_BYTES = 4 << 20
COLUMNS = 4096

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    names, out = _Names(), []
    for text in texts:
        found = text.encode().translate(_TABLE).split()
        words = np.fromiter(map(names.__getitem__, found), np.uint64, len(found))
        span = min(width, len(words))
        if not span:
            out.append(words)
            continue
        code = np.full(len(words) - span + 1, span, np.uint64)
        for i in range(span):
            code = code * _ODD + words[i : len(words) - span + 1 + i]
        out.append(np.unique(_mix(code)))
    return out


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99)
    draw = lambda: rng.integers(0, 1 << 63, count, np.uint64)
    return draw() << np.uint64(1) | np.uint64(1), draw()


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values: per hash function the high half of the smallest image."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        images = shingles[i : i + 1024, None] * a + b
        np.minimum(least, images.min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def signed_documents(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Key, doc_id, size and 128-bit name of the shingle set, and its signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(trees * depth)
        for piece in sliced(batches, "text", SLICE_BYTES):
            sets = shingle_sets(piece.column("text").to_pylist())
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            arrays = [piece.column(c) for c in (*KEY, "doc_id")]
            arrays += [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(halves[:, i].copy()) for i in (0, 1))]
            arrays.append(pa.array([signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEY, "doc_id", "n", "f", "g", "sig"])

    schema = f"{KEY[0]} LONG, {KEY[1]} LONG, doc_id LONG, n LONG, f LONG, g LONG, sig BINARY"
    return settle(keyed(docs, texts()).mapInArrow(sign, schema))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups out of batches that are sorted by the keys; the last one waits for its rest."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(table) else []
        start = 0
        for stop in new:
            yield table.slice(start, stop - start)
            start = int(stop)
        rest = table.slice(start).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def _dealt(members: DataFrame, group: str, block: int) -> DataFrame:
    """Rows (group, size, v, ..) dealt out as pairs (lo, hi) of blocks of their group."""
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("v"), parts.cast("long")).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = members.withColumn("own", own).withColumn("other", pairs)
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    dealt = dealt.drop("other", "size")
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _stars(linked: np.ndarray) -> np.ndarray:
    """Of each member the smallest member it is connected to."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(linked, label, np.int32(len(linked))).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _node_edges(keys: list[str], least: float) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            v = group.column("v").to_numpy()
            if len(v) < 2:
                continue
            values = np.frombuffer(b"".join(group.column("sig").to_pylist()), ">u4").reshape(len(v), -1)
            order = np.argsort(v)
            v, values = v[order], values[order].astype(np.uint32)
            if len(v) == 2:
                label = np.array([0, 0 if (values[0] == values[1]).mean() >= least else 1])
            else:
                # The lowest byte of a value tells two apart all but once in 256.
                low = np.ascontiguousarray((values & 255).astype(np.uint8).T)
                same = np.zeros((len(v), len(v)), np.uint8 if len(low) < 256 else np.uint16)
                for column in low:
                    same += column[:, None] == column
                label = _stars(same >= least * len(low))
            own = label != np.arange(len(v))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[own]), pa.array(v[label[own]])], names=["a", "b"])

    return compare


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex of each vertex's connected component: (v, root).

    Labels sink along edges and jump to their label's label, so the number of rounds grows with the
    logarithm of a component's width. Each round is written to the shared folder.
    """
    edges = settle(edges.distinct())
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settle(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(heard, F.col("v") == F.col("a")).select("v", "root", F.least("root", "m").alias("low"))
        low = settle(low)
        top = low.select(F.col("v").alias("at"), F.col("low").alias("jump"))
        step = settle(low.join(top, F.col("low") == F.col("at")).select("v", "root", F.least("low", "jump").alias("new")))
        if step.filter("new != root").isEmpty():
            return step.select("v", "root")
        labels = step.select("v", F.col("new").alias("root"))


def _verify(keys: list[str], threshold: float) -> Callable:
    """Exact comparison of block pairs: rows (v, null, linked sets, linked documents) and star edges (v, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            v, first = np.unique(group.column("v").to_numpy(), return_index=True)
            group = group.take(first)
            sets = shingle_sets(group.column("text").to_pylist())
            shared = _intersections(sets)
            size = np.array([len(s) for s in sets], np.int64)
            union = size[:, None] + size - shared
            linked = shared >= threshold * union - 1e-9
            own, lo, hi = (group.column(c).to_numpy() for c in ("own", "lo", "hi"))
            across = own[:, None] != own if lo[0] != hi[0] else np.ones_like(linked)
            np.fill_diagonal(linked, False)
            linked &= across
            weight = group.column("copies").to_numpy()
            count, docs = linked.sum(1), linked @ weight
            label = _stars(linked)
            star = np.flatnonzero(label != np.arange(len(v)))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([v[some], v[star]])),
                    pa.array([None] * len(some) + v[label[star]].tolist(), pa.int64()),
                    pa.array(np.concatenate([count[some], 0 * star]).astype(np.int64)),
                    pa.array(np.concatenate([docs[some], 0 * star]).astype(np.int64)),
                ],
                names=["v", "b", "sets", "docs"],
            )

    return compare


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(place) > 1
    column = np.cumsum(common) - 1
    use = common[place]
    owner, column = owner[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    return np.rint(shared).astype(np.int64)


def near_labels(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """One row per input row: key, doc_id, class_id, copy_id, n_copies, n_links, and whether it is the class's first.

    The first of a class is its smallest doc_id (null last). Repeated rows are copies of each other.
    """
    signed = signed_documents(docs, trees, depth)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)
    sets = signed.filter("n > 0").groupBy("n", "f", "g").agg(
        F.count("*").alias("copies"), F.min(order).alias("first"), F.min("sig").alias("sig")
    )
    sets = settle(sets.select(F.monotonically_increasing_id().alias("v"), "*"))

    prefix = prefix_depth(threshold, trees, depth, recall)
    each = F.sequence(F.lit(0), F.lit(trees - 1))
    node = lambda t: F.xxhash64(t, F.col("sig").substr(t * (4 * depth) + 1, F.lit(4 * prefix)))
    forest = settle(sets.select("v", F.explode(F.transform(each, node)).alias("node")))
    nodes = settle(forest.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
    members = forest.join(nodes, "node").join(sets.select("v", "sig"), "v")
    keys = ["node", "lo", "hi"]
    edges = _dealt(members, "node", NODE_BLOCK).mapInArrow(_node_edges(keys, threshold - MARGIN), "a LONG, b LONG")
    groups = components(edges)

    sizes = settle(groups.groupBy("root").agg(F.count("*").alias("size")))
    heads = groups.join(sizes, "root").join(sets.select("v", "copies", "first"), "v")
    heads = settle(heads.select("v", "root", "size", "copies", *(F.col(f"first.{k}").alias(k) for k in KEY)))
    read = keyed(docs, texts()).drop("doc_id")
    keys = ["root", "lo", "hi"]
    # Whole texts meet the groups in a shuffle at every size, and hot keys of it can be split.
    found = settle(
        _dealt(heads.join(read.hint("merge"), KEY).drop(*KEY), "root", GROUP_BLOCK).mapInArrow(
            _verify(keys, threshold), "v LONG, b LONG, sets LONG, docs LONG"
        )
    )
    links = found.filter("b IS NULL").groupBy("v").agg(F.sum("docs").alias("docs"))
    roots = components(found.filter("b IS NOT NULL").select(F.col("v").alias("a"), "b"))

    placed = sets.select("v", "n", "f", "g", "copies", "first").join(roots, "v", "left").join(links, "v", "left")
    placed = settle(placed.withColumn("root", F.coalesce("root", "v")).fillna(0, ["docs"]))
    classes = placed.groupBy("root").agg(F.min("first").alias("class"))
    classes = classes.select((F.col("root") + F.lit(0)).alias("r"), "class")
    placed = settle(placed.join(classes, F.col("root") == F.col("r")).drop("r", "root", "v"))
    out = signed.drop("sig").join(placed, ["n", "f", "g"], "left")
    known = F.col("first").isNotNull()
    return out.select(
        *KEY,
        "doc_id",
        F.when(known, F.col("class.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(known, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        (~known | (F.struct(*KEY) == F.struct(*(F.col(f"class.{k}") for k in KEY)))).alias("is_first"),
    )


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_copies, n_links."""
    return near_labels(docs, **options).drop("is_first", *KEY)


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns: of every class its first document.

    Of rows that repeat its doc_id and text, the first by their other columns stays.
    """
    stay = settle(near_labels(docs, **options).filter("is_first").select(*KEY).distinct())
    rows = packed(docs).join(stay, KEY, "left_semi")
    return rows.groupBy(*KEY).agg(F.min_by("row", besides_text(docs)).alias("row")).select("row.*")
